"""Eligibility filters and box tests for candidate water bodies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Feature codes of lakes, reservoirs and estuaries.
FEATURE_TYPES = (390, 436, 493)


def eligible_bodies(
    df: DataFrame, *, code: str, kind: str, source_id: str, area: str, codes: Sequence[int] = FEATURE_TYPES
) -> DataFrame:
    """Polygons of a wanted feature type with an id and at least one square metre."""
    return df.where(
        F.col(code).isin(*codes)
        & F.col(kind).isin("Polygon", "MultiPolygon")
        & F.col(source_id).isNotNull()
        & (F.col(area) >= 1)
    )


def inside_box(x: str, y: str, box: tuple[float, float, float, float]) -> Column:
    """Half-open bounding-box test."""
    west, south, east, north = box
    return (F.col(x) >= west) & (F.col(x) < east) & (F.col(y) >= south) & (F.col(y) < north)


def hashed_candidates(
    df: DataFrame, *, source_id: str, rank: Column, limit: int | None = None
) -> DataFrame:
    """Distinct ids in a deterministic hash order. ``limit`` is the caller's sample size."""
    ranked = df.groupBy(source_id).agg(F.min(rank).alias("rank"))
    return ranked if limit is None else ranked.orderBy("rank", source_id).limit(limit)


def with_center(bodies: DataFrame, rings: DataFrame, keys: Sequence[str], area: Column) -> DataFrame:
    """Valid candidates with their center and area band. The center is the area centroid of the
    polygon, summed over its edges."""
    from tarnscope.functions.scalars import area_band
    from tarnscope.operators.geometry import boundary_edges

    edges = boundary_edges(rings, keys)
    cross = (F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) * F.col("turn")
    sums = edges.groupBy(*keys).agg(
        F.sum(cross).alias("_a"), F.sum((F.col("x1") + F.col("x2")) * cross).alias("_x"), F.sum((F.col("y1") + F.col("y2")) * cross).alias("_y")
    )
    valid = sums.where(F.col("_a") != 0)
    center = valid.select(*keys, (F.col("_x") / (F.col("_a") * 3)).alias("center_x"), (F.col("_y") / (F.col("_a") * 3)).alias("center_y"))
    return bodies.join(center, list(keys)).withColumn("area_band", area_band(area))


def strata(points: DataFrame, x: str, y: str, box: tuple[float, float, float, float], columns: int, rows: int) -> DataFrame:
    """Points inside a half-open box with their ``stratum``, numbered column by column."""
    west, south, east, north = box
    column = F.floor((F.col(x) - west) * columns / (east - west))
    row = F.floor((F.col(y) - south) * rows / (north - south))
    return points.where(inside_box(x, y, box)).withColumn("stratum", (column * rows + row).cast("int"))


def hashed_per_stratum(points: DataFrame, keys: Sequence[str], rank: Column, source_id: str, limit: int) -> DataFrame:
    """The first ids of every stratum in a fixed hash order, with their ``place`` from 1. A task keeps no more of
    a stratum than the limit before anything is shuffled."""
    from pyspark.sql import Window

    order = Window.partitionBy(*keys).orderBy("_rank", source_id)
    return points.withColumn("_rank", rank).withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).drop("_rank")


def nearest_by_band(points: DataFrame, band: str, quotas: dict[str, int], distance: Column, ties: Sequence[str]) -> DataFrame:
    """The points of each band that are nearest, as many as its quota: one bounded top list a band."""
    measured = points.withColumn("distance", distance)
    parts = [measured.where(F.col(band) == name).orderBy("distance", *ties).limit(n) for name, n in sorted(quotas.items()) if n]
    out = parts[0] if parts else measured.limit(0)
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
