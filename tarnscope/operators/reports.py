"""Report tables: coverage by month, headline numbers, findings and workload comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def coverage_by_month(gaps: DataFrame, fallback: DataFrame, month: str = "month") -> DataFrame:
    """Expected, present, filled and uncovered acquisitions per month over all tiles. Fill
    counts exist for incomplete tile-months only."""
    a = gaps.select(month, "reference", F.col("primary").alias("present"), F.lit(0).alias("fill"), F.lit(0).alias("uncovered"))
    rest = F.col("uncovered") + F.col("partial_cog") + F.col("jp2_only")
    b = fallback.select(month, F.lit(0).alias("reference"), F.lit(0).alias("present"), F.col("complete_cog").alias("fill"), rest.alias("uncovered"))
    return a.unionByName(b).groupBy(month).agg(*[F.sum(c).alias(c) for c in ("reference", "present", "fill", "uncovered")])


def coverage_strip(rows: DataFrame, steps: int = 10) -> DataFrame:
    """Share present alone and with the fill, and an intensity step for each. Null where
    nothing was expected."""
    whole = F.nullif("reference", F.lit(0))
    alone, filled = F.try_divide("present", whole), F.try_divide(F.col("present") + F.col("fill"), whole)

    def shade(x: Column) -> Column:
        return F.least(F.floor(x * steps), F.lit(steps)).cast("int")

    return rows.withColumns(
        {"share": F.round(alone, 6), "share_filled": F.round(filled, 6), "shade": shade(alone), "shade_filled": shade(filled)}
    )


def layouts(df: DataFrame, layout: Sequence[str], value: str) -> DataFrame:
    """Distinct layouts with the sorted values they occur with and how often."""
    pairs = df.groupBy(*layout, value).agg(F.count(F.lit(1)).alias("_n"))
    return pairs.groupBy(*layout).agg(F.array_sort(F.collect_list(value)).alias("values"), F.sum("_n").alias("n"))


def findings(totals: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per finding from a one-row table of totals."""
    pairs = F.array(*[F.struct(F.lit(c).alias("finding"), F.col(c).cast("double").alias("value")) for c in columns])
    return totals.select(F.inline(pairs))


def option_workloads(rows: DataFrame, keys: Sequence[str], option: str, options: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Both options' workloads side by side with ratios. A combination that occurs twice, or is
    not complete, is an error."""
    counted = rows.groupBy(*keys, option).agg(
        F.count(F.lit(1)).alias("_n"), F.bool_and("complete").alias("_ok"), *[F.sum(v).alias(v) for v in values]
    )
    bad = F.raise_error(F.lit("workload is repeated or not complete")).cast("bigint")
    checked = counted.withColumn("_n", F.when((F.col("_n") == 1) & F.col("_ok"), F.col("_n")).otherwise(bad))
    aggs = [F.sum(F.when(F.col(option) == o, F.col("_n"))).alias(f"runs_{o}") for o in options]
    for v in values:
        aggs += [F.sum(F.when(F.col(option) == o, F.col(v))).alias(f"{v}_{o}") for o in options]
    wide = checked.groupBy(*keys).agg(*aggs)
    a, b = options
    return wide.withColumns({f"{v}_ratio": F.round(F.try_divide(F.col(f"{v}_{a}"), F.nullif(f"{v}_{b}", F.lit(0))), 6) for v in values})


def headline(df: DataFrame, value: Column, ok: Column, message: str) -> DataFrame:
    """A headline number, refused where its inputs are not complete and equal."""
    return df.withColumn("headline", F.when(ok, value).otherwise(F.raise_error(F.lit(message)).cast("double")))


def largest_with_ties(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """The largest value per key and the sorted names that share it."""
    top = df.groupBy(*keys, name).agg(F.max(value).alias(value))
    rank = F.rank().over(Window.partitionBy(*keys).orderBy(F.desc(value)))
    tied = top.withColumn("_r", rank).where("_r = 1")
    return tied.groupBy(*keys).agg(F.max(value).alias(value), F.array_join(F.array_sort(F.collect_list(F.col(name).cast("string"))), ",").alias("names"))


def percent_range(low: Column, high: Column) -> Column:
    """Whole percents, one value when they round alike, else the lowest to the highest."""
    a, b = (F.bround(x * 100, 0).cast("bigint").cast("string") for x in (low, high))
    return F.when(a == b, a).otherwise(F.concat(a, F.lit(" to "), b))


def placed_once(issues: DataFrame, issue: str) -> DataFrame:
    """Every issue with the number of its placements; another number than one is named."""
    counted = issues.groupBy(issue).agg(F.count("place").alias("placements"))
    state = F.when(F.col("placements") == 0, "not placed").when(F.col("placements") > 1, "placed twice").otherwise("ok")
    return counted.withColumn("state", state)


def only_row(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The single row per key. None or several is an error."""
    fail = F.raise_error(F.lit("expected one row per key")).cast("bigint")
    grouped = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.first(v).alias(v) for v in values])
    return grouped.withColumn("_n", F.when(F.col("_n") == 1, F.col("_n")).otherwise(fail)).where("_n = 1").drop("_n")


def families(df: DataFrame, keys: Sequence[str], digest: str) -> DataFrame:
    """Earlier digests by family: how many distinct, and the first two."""
    one = df.groupBy(*keys, digest).agg(F.count(F.lit(1)).alias("_n"))
    return one.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("digests"), F.min(digest).alias("first_digest"), F.max(digest).alias("last_digest"), F.sum("_n").alias("records")
    )
