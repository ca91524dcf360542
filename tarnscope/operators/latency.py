"""How long each product took to arrive: folders, clocks, percentiles and censoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnscope.functions.scalars import hours_between, rounded
from tarnscope.operators.quantiles import nearest_rank

# Percentiles reported and the arrival thresholds in hours.
FRACTIONS = {"p10": 0.1, "median": 0.5, "p90": 0.9, "p99": 0.99}
WITHIN_HOURS = (6, 12, 24, 72)
SLOWEST = 15


def folders(objects: DataFrame, folder: str, modified: str) -> DataFrame:
    """Earliest and latest object time and the number of objects per folder."""
    return objects.where(F.col(modified).isNotNull()).groupBy(folder).agg(
        F.min(modified).alias("first"), F.max(modified).alias("last"), F.count(F.lit(1)).alias("objects")
    )


def folder_of(key: Column) -> Column:
    """The folder above an object, null for a key without one."""
    parts = F.split(key, "/")
    return F.when(F.size(parts) >= 2, F.element_at(parts, -2))


def clock_hours(items: DataFrame, sensing: str, clocks: Sequence[str]) -> DataFrame:
    """Hours of every clock after the sensing start, null where the clock is missing."""
    return items.withColumns({f"{c}_hours": hours_between(F.col(sensing), F.col(c)) for c in clocks})


def clocks_to_rows(items: DataFrame, keep: Sequence[str], clocks: Sequence[str]) -> DataFrame:
    pairs = F.array(
        *[F.struct(F.lit(c).alias("clock"), F.col(f"{c}_hours").alias("hours")) for c in clocks]
    )
    return items.select(*keep, F.inline(pairs)).where(F.col("hours").isNotNull())


def latency_stats(rows: DataFrame, groups: Sequence[str], hours: str, days: bool = True, bucket: float = 240.0) -> DataFrame:
    """Nearest-rank percentiles, minimum and maximum in days or signed hours."""
    stats = nearest_rank(rows, groups, hours, FRACTIONS, bucket)
    scale = 24.0 if days else 1.0
    return stats.select(
        *groups, "n", *[rounded(F.col(c) / scale, 2).alias(c) for c in (*FRACTIONS, "min", "max")]
    )


def within(hours: DataFrame, groups: Sequence[str], value: str, denominator: Column) -> DataFrame:
    """Share of a fixed denominator at or under each threshold."""
    share = [
        rounded(F.try_divide(F.count_if(F.col(value) <= h), F.nullif(denominator, F.lit(0))), 4).alias(f"within_{h}h")
        for h in WITHIN_HOURS
    ]
    return hours.groupBy(*groups).agg(*share)


def archive_status(products: DataFrame, items: DataFrame, *, name: str, pass_key: str) -> DataFrame:
    """Archive products whose name is in the catalog, whose pass is there under another name,
    or that are absent."""
    names = items.select(F.col(name)).distinct().withColumn("_name", F.lit(True))
    passes = items.where(F.col(pass_key).isNotNull()).select(pass_key).distinct().withColumn("_pass", F.lit(True))
    joined = products.join(names, name, "left").join(passes, pass_key, "left")
    status = (
        F.when(F.col("_name"), "same_product").when(F.col("_pass"), "pass_other_product").otherwise("absent")
    )
    return joined.withColumn("status", status).drop("_name", "_pass")
