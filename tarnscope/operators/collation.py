"""Collation of a stage: what was expected against what was measured, at every level in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def expected_bands(scenes: DataFrame, members: DataFrame, assets: DataFrame, bands: Sequence[str]) -> DataFrame:
    """``tile, member, band, resolution, resolved``: what a run called for.

    A requested band that a scene could not resolve stays expected, without a resolution, so a failed asset
    never shrinks the expectation. ``scenes`` has ``tile``, ``assets`` ``tile, band, resolution``.
    """
    wanted = scenes.select("tile").distinct().withColumn("band", F.explode(F.array(*map(F.lit, bands))))
    have = assets.select("tile", "band", "resolution").distinct()
    keys = wanted.join(have, ["tile", "band"], "full_outer").select("tile", "band", "resolution", F.col("resolution").isNotNull().alias("resolved"))
    return keys.join(members.select("tile", "member").distinct(), "tile").select("tile", "member", "band", "resolution", "resolved")


def _one(value: Column, where: Column) -> Column:
    """Whether all values under a condition are one and none is missing; null without any."""
    n = F.count_if(where)
    known = F.when(where, value)
    return F.when(n > 0, F.coalesce(F.min(known) == F.max(known), F.lit(False)) & (F.count_if(where & value.isNull()) == 0))


def method_equality(records: DataFrame, expected: DataFrame, earlier: DataFrame, keys: Sequence[str], planned: int, naive: str) -> DataFrame:
    """One row per expected or measured key: how many of the planned runs it has, and which digests agree.

    ``records`` has the keys, ``run, method, digest_all, digest_wet``; ``earlier`` the keys and ``digest`` of an
    earlier stage. Mask methods must agree with each other, the naive one with itself across patterns, with
    the wet pixels of the others, and all of them with the earlier stage. What cannot be compared is null.

    Every figure is one of the set of records, so repeated ones go before they are moved. What is left of a key
    are its runs and digests, which need no distinct count.
    """
    is_naive = F.col("method") == naive
    once = records.groupBy(*keys, "run", "method", "digest_all", "digest_wet").agg(F.lit(1).alias("_once"))
    found = once.groupBy(*keys).agg(
        F.size(F.collect_set("run")).cast("bigint").alias("records"), _one(F.col("digest_all"), ~is_naive).alias("mask_methods_identical"), _one(F.col("digest_all"), is_naive).alias("naive_identical"),
        F.array_sort(F.collect_set(F.when(is_naive, F.col("digest_all")))).alias("_naive"), F.array_sort(F.collect_set(F.when(~is_naive, F.col("digest_wet")))).alias("_wet"),
    )
    before = earlier.groupBy(*keys).agg(F.array_sort(F.collect_set("digest")).alias("_before"))
    rows = expected.join(found, list(keys), "full_outer").join(before, list(keys), "left")
    both = lambda a, b: F.when((F.size(a) > 0) & (F.size(b) > 0), F.col(a) == F.col(b))
    n = F.coalesce("records", F.lit(0))
    more = [F.coalesce(c, F.lit(False)).alias(c) if c == "resolved" else F.col(c) for c in expected.columns if c not in keys]
    return rows.select(
        *keys, *more, n.alias("records"), (n == planned).alias("complete"), (F.lit(planned) - n).alias("missing"), "mask_methods_identical", "naive_identical",
        both("_naive", "_wet").alias("naive_matches_wet"), both("_wet", "_before").alias("matches_earlier"), F.when(F.size("_before") > 0, F.size("_before") == 1).alias("earlier_consistent"),
    )


def configuration_status(configurations: DataFrame, attempts: DataFrame, results: DataFrame) -> DataFrame:
    """``configuration, status, matches_all``: not_attempted, incomplete, differs or complete.

    ``attempts`` has ``configuration, ended``, ``results`` ``configuration, rows, expected, signature``. A complete one ended and
    has all its rows. If complete ones have more than one signature, all of them differ: none is named as
    the right one. ``matches_all`` needs two to compare.
    """
    tried = attempts.groupBy("configuration").agg(F.bool_or("ended").alias("_ended"))
    found = results.groupBy("configuration").agg(F.sum("rows").alias("_rows"), F.sum("expected").alias("_want"), F.min("signature").alias("_s"), F.count_distinct("signature").alias("_n"))
    rows = configurations.select("configuration").distinct().join(tried, "configuration", "left").join(found, "configuration", "left")
    whole = F.coalesce(F.col("_ended") & (F.col("_rows") == F.col("_want")) & (F.col("_n") == 1), F.lit(False))
    rows = rows.withColumn("_whole", whole)
    # One row as a value, so that the status needs no window over all configurations.
    complete = rows.where("_whole").agg(F.struct(F.count(F.lit(1)).alias("n"), F.count_distinct("_s").alias("kinds")).alias("_c")).scalar()
    rows = rows.withColumn("_c", complete)
    status = F.when(F.col("_ended").isNull(), "not_attempted").when(~F.col("_whole"), "incomplete").when(F.col("_c.kinds") > 1, "differs").otherwise("complete")
    return rows.select("configuration", status.alias("status"), F.when(F.col("_whole"), (F.col("_c.n") >= 2) & (F.col("_c.kinds") == 1)).alias("matches_all"))


def stage_levels(rows: DataFrame, levels: Sequence[Sequence[str]], checks: Sequence[str]) -> DataFrame:
    """Counts at every level in one pass of grouping sets: ``level`` names its columns, the others are null.

    ``rows`` come from ``method_equality``; a check counts where it is true, false or could not be made.
    """
    every = list(dict.fromkeys(c for level in levels for c in level))
    counts = [F.count(F.lit(1)).alias("expected"), F.count_if("complete").alias("complete"), F.count_if(~F.col("complete")).alias("incomplete"), F.count_if(~F.col("resolved")).alias("unresolved"), F.sum("records").alias("records")]
    for name in checks:
        counts += [F.count_if(name).alias(f"{name}_yes"), F.count_if(~F.col(name)).alias(f"{name}_no")]
    named = F.concat_ws("+", *[F.when(F.grouping(c) == 0, c) for c in every])
    sets = [[F.col(c) for c in level] for level in levels]
    out = rows.groupingSets(sets, *[F.col(c) for c in every]).agg(F.when(named == "", "all").otherwise(named).alias("level"), *counts)
    return out.select("level", *every, *[c for c in out.columns if c not in (*every, "level")])
