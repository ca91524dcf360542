"""Catalog coverage: which acquisitions an archive lacks and what could fill them.

Sets of acquisition keys are kept as flags on one row per distinct key, so that a comparison
of three archives is one aggregation (combined map-side) in place of three anti joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnscope.functions.scalars import cloud_bin, cloud_labels, month_list, month_text


def distinct_acquisitions(df: DataFrame, keys: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """One row per acquisition with the archives that hold it and its item count."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("items"), *[F.bool_or(flag).alias(flag) for flag in flags]
    )


def dense_months(
    df: DataFrame, keys: Sequence[str], month: str, measures: dict[str, object], start: Column, end: Column
) -> DataFrame:
    """Fill absent months of every key with defaults.

    The input holds one row per key and month, so collecting the months of a key is bounded by
    the length of the window. No join and no second scan are needed.
    """
    row = F.struct(*[F.col(m) for m in measures])
    packed = df.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(month, row))).alias("_m"))
    rows = packed.select(*keys, F.explode(month_list(start, end)).alias("_d"), "_m").select(
        *keys, month_text(F.col("_d")).alias(month), F.element_at("_m", month_text(F.col("_d"))).alias("_r")
    )
    return rows.select(
        *keys, month, *[F.coalesce(F.col(f"_r.{m}"), F.lit(d)).alias(m) for m, d in measures.items()]
    )


def month_status(reference: Column, primary: Column, missing: Column) -> Column:
    """no_reference, primary_only, complete, empty or partial, tested in this order."""
    return (
        F.when((reference == 0) & (primary == 0), "no_reference")
        .when(reference == 0, "primary_only")
        .when(missing == 0, "complete")
        .when(primary == 0, "empty")
        .otherwise("partial")
    )


def compare_archives(
    df: DataFrame,
    keys: Sequence[str],
    month: str,
    acquisition: str,
    flags: tuple[str, str, str],
    start: Column,
    end: Column,
) -> DataFrame:
    """Per key and month: how many acquisitions the primary archive lacks, how many of them
    the fallback holds, and a status. Counts are of distinct acquisitions, not items."""
    ref, pri, fall = (F.col(f) for f in flags)
    acquisitions = distinct_acquisitions(df, [*keys, month, acquisition], flags)
    counts = acquisitions.groupBy(*keys, month).agg(
        F.count_if(ref).alias("reference"),
        F.count_if(pri).alias("primary"),
        F.count_if(ref & ~pri).alias("missing"),
        F.count_if(ref & ~pri & fall).alias("covered_by_fallback"),
        F.count_if(ref & ~pri & ~fall).alias("uncovered"),
        F.count_if(pri & ~ref).alias("primary_not_in_reference"),
    )
    measures = (
        ("reference", "primary", "missing", "covered_by_fallback", "uncovered", "primary_not_in_reference")
    )
    dense = dense_months(counts, keys, month, dict.fromkeys(measures, 0), start, end)
    return dense.withColumn(
        "status", month_status(F.col("reference"), F.col("primary"), F.col("missing"))
    )


def uncovered_acquisitions(
    df: DataFrame, keys: Sequence[str], month: str, acquisition: str, flags: tuple[str, str, str]
) -> DataFrame:
    """The acquisitions the reference holds and neither other archive does, as rows."""
    ref, pri, fall = (F.col(f) for f in flags)
    acquisitions = distinct_acquisitions(df, [*keys, month, acquisition], flags)
    return acquisitions.where(ref & ~pri & ~fall).select(*keys, month, acquisition)


def monthly_summary(
    df: DataFrame, keys: Sequence[str], month: str, acquisition: str, start: Column, end: Column
) -> DataFrame:
    """Items, distinct acquisitions and duplicated acquisitions per month."""
    per_key = df.groupBy(*keys, month, acquisition).agg(F.count(F.lit(1)).alias("n"))
    counts = per_key.groupBy(*keys, month).agg(
        F.sum("n").alias("items"),
        F.count(F.lit(1)).alias("acquisitions"),
        F.count_if(F.col("n") > 1).alias("duplicate_acquisitions"),
    )
    return dense_months(
        counts, keys, month, {"items": 0, "acquisitions": 0, "duplicate_acquisitions": 0}, start, end
    )


def value_counts(df: DataFrame, keys: Sequence[str], value: Column, name: str = "value") -> DataFrame:
    """Counts of a value as text, a missing value counted as ``None``."""
    text = F.coalesce(value.cast("string"), F.lit("None")).alias(name)
    return df.select(*keys, text).groupBy(*keys, name).agg(F.count(F.lit(1)).alias("n"))


def duplicate_sets(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """How often each multiset of values occurs among the duplicated acquisitions.

    Values are counted per acquisition first, so the text of one acquisition holds each
    distinct value once with its count, however many items it has.
    """
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    pair = F.struct(F.col(value).alias("v"), F.col("n").alias("n"))
    per_key = counted.groupBy(*keys).agg(
        F.sum("n").alias("items"), F.array_sort(F.collect_list(pair)).alias("values")
    )
    text = F.array_join(
        F.transform("values", lambda p: F.concat(p["v"], F.lit("x"), p["n"].cast("string"))), "+"
    )
    return (
        per_key.where(F.col("items") > 1)
        .select(text.alias("values"))
        .groupBy("values")
        .agg(F.count(F.lit(1)).alias("acquisitions"))
    )


def status_by_month(gaps: DataFrame, month: str = "month") -> DataFrame:
    """Tiles per status and month, and whether a month is empty everywhere or incomplete
    anywhere."""
    status = F.col("status")
    return gaps.groupBy(month).agg(
        *[
            F.count_if(status == name).alias(f"tiles_{name}")
            for name in ("no_reference", "primary_only", "complete", "empty", "partial")
        ],
        F.sum("missing").alias("missing"),
        F.sum("uncovered").alias("uncovered"),
        F.bool_and(status == "empty").alias("empty_everywhere"),
        F.bool_or(status.isin("empty", "partial")).alias("incomplete_anywhere"),
    )


def incomplete_months(gaps: DataFrame) -> DataFrame:
    return gaps.where(F.col("status").isin("empty", "partial"))


def month_spans(months: DataFrame, keys: Sequence[str], month: str) -> DataFrame:
    """Contiguous runs of months per key: gaps and islands over at most one row per month."""
    from pyspark.sql import Window

    distinct = months.select(*keys, month).distinct()
    index = F.substring(month, 1, 4).cast("int") * 12 + F.substring(month, 6, 2).cast("int")
    order = Window.partitionBy(*keys).orderBy(month)
    island = (index - F.row_number().over(order)).alias("_island")
    return (
        distinct.select(*keys, month, island)
        .groupBy(*keys, "_island")
        .agg(F.min(month).alias("first"), F.max(month).alias("last"), F.count(F.lit(1)).alias("months"))
        .drop("_island")
    )


CLASS_ORDER = ("none", "no_data_assets", "jp2_only", "partial_cog", "complete_cog")


def asset_class(complete: Column, cog_assets: Column, jp2_assets: Column) -> Column:
    """Rank of one item's coverage class in ``CLASS_ORDER``."""
    return (
        F.when(complete, 4).when(cog_assets > 0, 3).when(jp2_assets > 0, 2).otherwise(1)
    )


def fallback_per_acquisition(
    df: DataFrame,
    keys: Sequence[str],
    *,
    reference: Column,
    primary: Column,
    older: Column,
    complete: Column,
    cog_assets: Column,
    jp2_assets: Column,
    baseline: Column,
    item: Column,
) -> DataFrame:
    """For every acquisition the primary archive lacks: the best coverage class among the
    older collection's items and the item a fill would use. One aggregation, no join."""
    rank = F.when(older, asset_class(complete, cog_assets, jp2_assets))
    order = F.when(older, F.struct(
        complete.cast("int").alias("complete"), cog_assets.alias("assets"),
        baseline.alias("baseline"), item.alias("item"),
    ))
    grouped = df.groupBy(*keys).agg(
        F.bool_or(reference).alias("_ref"),
        F.bool_or(primary).alias("_pri"),
        F.coalesce(F.max(rank), F.lit(0)).alias("_rank"),
        F.max(order).alias("_best"),
    )
    names = F.array(*[F.lit(c) for c in CLASS_ORDER])
    return grouped.where(F.col("_ref") & ~F.col("_pri")).select(
        *keys,
        F.element_at(names, F.col("_rank") + 1).alias("coverage_class"),
        F.col("_best").getField("item").alias("best_item"),
        F.col("_best").getField("baseline").alias("best_baseline"),
    )


def fallback_by_month(missing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts of missing acquisitions by coverage class."""
    cls = F.col("coverage_class")
    return missing.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("missing"),
        *[F.count_if(cls == c).alias("uncovered" if c == "none" else c) for c in CLASS_ORDER],
    )


def lowest_per_acquisition(df: DataFrame, keys: Sequence[str], value: str, present: Column) -> DataFrame:
    """Lowest value per acquisition and whether the product archive holds it."""
    return df.groupBy(*keys).agg(F.min(value).alias(value), F.bool_or(present).alias("present"))


def cloud_comparison(acquisitions: DataFrame, keys: Sequence[str], cover: str) -> DataFrame:
    """Acquisitions by cover bin and presence, every bin reported."""
    side = F.when(F.col("present"), "present").otherwise("missing")
    binned = acquisitions.select(*keys, side.alias("side"), cloud_bin(F.col(cover)).alias("bin"))
    wide = binned.groupBy(*keys, "side").agg(
        *[F.count_if(F.col("bin") == label).alias(label) for label in cloud_labels()]
    )
    pairs = F.array(
        *[F.struct(F.lit(x).alias("bin"), F.col(f"`{x}`").alias("n")) for x in cloud_labels()]
    )
    return wide.select(*keys, "side", F.inline(pairs))


def listing_agreement(listed: DataFrame, counted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Independent counts side by side, absent on either side as zero, with a match flag."""
    joined = listed.withColumnRenamed("n", "listed").join(
        counted.withColumnRenamed("n", "counted"), list(keys), "full_outer"
    )
    a, b = F.coalesce("listed", F.lit(0)), F.coalesce("counted", F.lit(0))
    return joined.select(*keys, a.alias("listed"), b.alias("counted"), (a == b).alias("agree"))


def input_differences(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys only one of two surveys covers. Empty when they match."""
    only_first = first.select(*keys).distinct().join(second.select(*keys), list(keys), "left_anti")
    only_second = second.select(*keys).distinct().join(first.select(*keys), list(keys), "left_anti")
    return only_first.withColumn("side", F.lit("first")).unionByName(
        only_second.withColumn("side", F.lit("second"))
    )


def pooled(df: DataFrame, strata: Sequence[Sequence[str]], by: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Aggregate over several strata at once, labelled by kind and group, in one pass.

    ``strata`` lists the columns of each level; the empty level pools everything.
    """
    columns = sorted({c for level in strata for c in level})
    sets = [[F.col(c) for c in (*level, *by)] for level in strata]
    grouped = df.groupingSets(sets, *columns, *by).agg(*aggs, F.grouping_id(*columns, *by).alias("_gid"))
    kind, label = None, None
    width = len(columns) + len(by)
    order = [*columns, *by]
    for level in strata:
        gid = sum(1 << (width - 1 - i) for i, c in enumerate(order) if c not in level and c not in by)
        name = "+".join(level) or "all"
        text = F.concat_ws("/", *[F.col(c).cast("string") for c in level]) if level else F.lit("all")
        hit = F.col("_gid") == gid
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
        label = F.when(hit, text) if label is None else label.when(hit, text)
    return grouped.withColumns({"kind": kind, "group": label}).drop("_gid", *columns)
