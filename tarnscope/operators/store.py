"""A content-addressed store of prepared masks: what was computed from the same input is read, not computed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnscope.functions.digests import row_digest, set_digest
from tarnscope.operators import masks as mk
from tarnscope.operators.geometry import geometry_digest
from tarnscope.streaming.streams import path_exists

GRID = ("resolution", "x0", "y0", "rows", "cols")


def input_digests(rings: DataFrame, keys: Sequence[str], parameters: Column) -> DataFrame:
    """``keys, digest``: of everything a body's mask depends on, its rings, its grid and the parameters. Bodies
    of equal input share a digest, whatever their names."""
    shapes = rings.groupBy(*keys, *GRID).agg(set_digest(F.col("part"), F.col("ring"), geometry_digest(F.col("pts"))).alias("_shape"))
    return shapes.select(*keys, row_digest(F.col("_shape"), *[F.col(c) for c in GRID], parameters).alias("digest"))


def prepare_masks(rings: DataFrame, keys: Sequence[str], path: str, *, resolution: float, near_m: float = mk.NEAR_LAND_M, cap_m: float = mk.EDGE_CAP_M) -> tuple[DataFrame, DataFrame]:
    """The mask pixels of all bodies, and ``keys, digest, reused``: whether a body's mask was there already.

    Only digests that the store lacks are computed. They are appended as one run, named by the digests in
    it: its pixels first, then its index, which is what makes a run count. So a run that failed half-way
    is computed again into the same place, and one that is there is never repeated. A body without pixels
    is remembered too. ``rings`` carry their grid as in ``mask_pixels``.
    """
    spark = rings.sparkSession
    wanted = input_digests(rings, keys, F.lit(f"{near_m}|{cap_m}"))
    index, pixels = f"{path}/index", f"{path}/pixels"
    saved = spark.read.schema("digest string, run string").parquet(index).select("digest").distinct() if path_exists(spark, index) else wanted.select("digest").limit(0)
    told = wanted.join(saved.withColumn("_saved", F.lit(True)), "digest", "left").select(*keys, "digest", F.col("_saved").isNotNull().alias("reused"))
    # Decided before anything is written: afterwards all would be there.
    decisions = f"{path}/decisions"
    told.write.mode("overwrite").parquet(decisions)
    told = spark.read.schema(told.schema).parquet(decisions)
    missing = told.where("not reused")
    first = missing.groupBy("digest").agg(F.min(F.struct(*keys)).alias("_k")).select("digest", *[F.col(f"_k.{k}").alias(k) for k in keys])
    run = first.agg(F.count(F.lit(1)).alias("n"), set_digest(F.col("digest")).alias("run")).first()
    if run["n"]:
        fresh = mk.mask_pixels(rings.join(first, list(keys), "left_semi"), keys, resolution=resolution, near_m=near_m, cap_m=cap_m)
        fresh = fresh.join(first, list(keys)).select("digest", "row", "col", "pixel_class", "coverage", "edge_distance")
        fresh.write.mode("overwrite").parquet(f"{pixels}/run={run['run']}")
        first.select("digest").write.mode("overwrite").parquet(f"{index}/run={run['run']}")
    runs = spark.read.schema("digest string, run string").parquet(index).select("run").distinct()
    stored = spark.read.schema("digest string, row bigint, col bigint, pixel_class int, coverage double, edge_distance double, run string").parquet(pixels)
    stored = stored.join(runs, "run", "left_semi").drop("run")
    return told.select(*keys, "digest").join(stored, "digest").select(*keys, "digest", *[c for c in stored.columns if c != "digest"]), told
