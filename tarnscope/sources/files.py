"""Object listings, settings, manifests, headers, masks and file digests."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnscope.schemas import BODY_FEATURE, LISTED_OBJECT, LISTING_PAGE, RASTER_HEADER


# ------------------------------------------------------------------ object listings


def _object_columns(prefix: str = "") -> list[Column]:
    def c(name: str) -> Column:
        return F.col(f"{prefix}{name}")

    return [
        c("Key").alias("key"), F.coalesce(c("Size").try_cast("bigint"), F.lit(0)).alias("size"),
        F.regexp_replace(F.coalesce(c("ETag"), F.lit("")), '^"+|"+$', "").alias("etag"),
        c("LastModified").alias("last_modified"), c("StorageClass").alias("storage_class"),
    ]


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """Objects of saved listing pages. A page is split by row tag, so it is never one value."""
    rows = spark.read.format("xml").option("rowTag", "Contents").option("ignoreNamespace", "true").schema(LISTED_OBJECT).load(path)
    return rows.select(*_object_columns())


def listing_from_text(df: DataFrame, column: str, keep: Sequence[str]) -> DataFrame:
    """Pages held as text: objects, common prefixes and the continuation state as arrays."""
    options = {"ignoreNamespace": "true"}
    page = df.select(*keep, F.from_xml(column, LISTING_PAGE.simpleString(), options).alias("_p"))
    return page.select(
        *keep, F.coalesce(F.col("_p.IsTruncated") == "true", F.lit(False)).alias("truncated"), F.col("_p.NextContinuationToken").alias("next_token"),
        F.col("_p.CommonPrefixes.Prefix").alias("prefixes"), F.col("_p.Contents").alias("contents"),
    )


def listed_objects(pages: DataFrame, keep: Sequence[str]) -> DataFrame:
    return pages.select(*keep, F.explode("contents").alias("o")).select(*keep, *_object_columns("o."))


# ------------------------------------------------------------------ settings


def settings_lines(df: DataFrame, column: str, keep: Sequence[str]) -> DataFrame:
    """``key=value`` lines of a settings text. Blanks and comments are skipped and the last
    value of a key wins."""
    lines = df.select(*keep, F.posexplode(F.split(column, r"\r?\n")).alias("line_no", "raw"))
    text = F.trim("raw")
    kept = lines.where((text != "") & ~text.rlike("^[#;]") & text.contains("="))
    pair = F.split(F.trim("raw"), "=", 2)
    named = kept.select(*keep, "line_no", F.trim(pair[0]).alias("key"), F.trim(pair[1]).alias("value"))
    return named.groupBy(*keep, "key").agg(F.max_by("value", "line_no").alias("value"))


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """Settings of many small files, one row per file and key."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return settings_lines(files, "value", ["path"])


# ------------------------------------------------------------------ manifests


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """Features of GeoJSON collections, geometry kept as JSON text until it is needed."""
    from pyspark.sql.types import ArrayType, StructField, StructType

    collection = StructType([StructField("features", ArrayType(BODY_FEATURE))])
    raw = spark.read.schema(collection).json(path, multiLine=True)
    return bodies(raw.select(F.explode("features").alias("f")).select("f.*"))


def bodies(features: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return features.select(*keep, "properties.*", "bbox", F.col("geometry.type").alias("kind"), F.col("geometry.coordinates").alias("coordinates"))


def wanted_bodies(df: DataFrame, regions: Sequence[str] = (), ids: Sequence[str] = (), tiers: Sequence[str] = ()) -> DataFrame:
    """Filter by region, id and tier. An empty list does not filter."""
    for column, values in (("region", regions), ("water_body_id", ids), ("tier", tiers)):
        if values:
            df = df.where(F.col(column).isin(*values))
    return df


def rings_of(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Ring rows of polygons and multipolygons held as JSON text."""
    nested = "array<array<array<array<double>>>>"
    single = F.array(F.from_json("coordinates", "array<array<array<double>>>"))
    parts = F.when(F.col("kind") == "Polygon", single).otherwise(F.from_json("coordinates", nested))
    part = df.select(*keep, F.posexplode(parts).alias("part", "_rings"))
    ring = part.select(*keep, "part", F.posexplode("_rings").alias("ring", "_pts"))
    point = F.transform("_pts", lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return ring.select(*keep, "part", "ring", point.alias("pts"))


def survey_sites(df: DataFrame) -> DataFrame:
    """Survey sites of a manifest with their bounding boxes."""
    return df.select(
        F.col("water_body_id").alias("site_id"), "name", F.lit("pilot").alias("group"),
        *[F.element_at("bbox", i + 1).alias(n) for i, n in enumerate(("west", "south", "east", "north"))], F.coalesce("why", F.lit("")).alias("why"),
    )


# ------------------------------------------------------------------ headers, masks, digests


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RASTER_HEADER).json(path)


def header_digest() -> Column:
    """Digest of a header's grid."""
    return F.sha2(F.to_json(F.struct("epsg", "rows", "cols", "transform")), 256)


def save_masks(mask: DataFrame, path: str) -> None:
    """Mask pixels partitioned for reads by tile and resolution, sorted for small files."""
    mask.repartition("tile_id", "resolution_m", F.floor(F.col("row") / 512)).sortWithinPartitions("tile_id", "resolution_m", "body", "row", "col").write.mode(
        "errorifexists"
    ).partitionBy("tile_id", "resolution_m").parquet(path)


def load_masks(spark: SparkSession, path: str, tile: str | None = None, resolution: int | None = None) -> DataFrame:
    """Saved mask pixels; tile and resolution prune partitions."""
    df = spark.read.parquet(path)
    if tile is not None:
        df = df.where(F.col("tile_id") == tile)
    if resolution is not None:
        df = df.where(F.col("resolution_m") == resolution)
    return df


def mask_sizes(mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pixels per mask and the bytes of its index lists (two positions and a class)."""
    return mask.groupBy(*keys).agg(F.count(F.lit(1)).alias("pixels"), (F.count(F.lit(1)) * 9).alias("list_bytes"))


def write_result(df: DataFrame, path: str, fmt: str = "json") -> str:
    """Write a result as a new version beside the earlier ones and return its folder.

    The commit protocol marks a whole version with ``_SUCCESS``; readers take the latest marked one,
    so an earlier result stays readable until the new one is complete.
    """
    place = f"{path.rstrip('/')}/version={time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    df.write.format(fmt).save(place)
    return place


def latest_result(spark: SparkSession, path: str) -> str:
    """Folder of the latest whole version of a result."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop.Path(f"{path.rstrip('/')}/version=*/_SUCCESS"))
    places = sorted(str(f.getPath().getParent().toString()) for f in found or [])
    if not places:
        raise FileNotFoundError(f"no whole result at {path}")
    return places[-1]


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 and length of saved response files. These are small documents by contract; the
    tables themselves are never read this way."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("sha256"), "length")


def load_run(spark: SparkSession, manifest: str, responses: str) -> DataFrame:
    """Saved responses of a run, refused when one no longer matches the run's manifest."""
    from tarnscope.operators.checks import require_same_digest

    listed = spark.read.schema("name string, sha256 string").json(manifest)
    return require_same_digest(listed, file_digests(spark, responses), "name", "sha256")


def to_manifest_json(rows: list[dict]) -> str:
    """Manifest text of a run, one JSON object per line."""
    return "\n".join(json.dumps(r, sort_keys=True) for r in rows)
