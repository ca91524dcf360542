"""Exact order statistics that never bring one group's values into one task.

Values are counted first, so repeats cost nothing after the map side. A coarse bucket count
(range over bucket width per group) locates the bucket holding each wanted rank, and only the
distinct values of that bucket are ranked. A group with a third of all rows is therefore spread
over its buckets, unlike a built-in exact percentile, which holds a group's values in one state.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RankOf = Callable[[Column], Column]


def order_statistics(
    df: DataFrame, groups: Sequence[str], value: str, ranks: dict[str, RankOf], bucket: float
) -> DataFrame:
    """The values at 1-based ranks of every group, with its n, min and max.

    ``ranks`` maps an output name to a function of the group size. ``bucket`` is the width of
    the coarse buckets; range over width bounds the rows of the cumulative step.
    """
    keys = [f"_g{i}" for i in range(len(groups))]
    rows = df.where(F.col(value).isNotNull()).select(
        *[F.col(g).alias(k) for g, k in zip(groups, keys, strict=True)], F.col(value).alias("_v")
    )
    coarse = F.floor(F.col("_v") / F.lit(bucket)).cast("bigint")
    fine = rows.groupBy(*keys, coarse.alias("_b"), "_v").agg(F.count(F.lit(1)).alias("_c"))
    buckets = fine.groupBy(*keys, "_b").agg(
        F.sum("_c").alias("_c"), F.min("_v").alias("_min"), F.max("_v").alias("_max")
    )
    total = Window.partitionBy(*keys)
    running = total.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = buckets.select(
        *keys,
        "_b",
        (F.sum("_c").over(running) - F.col("_c")).alias("_before"),
        F.col("_c"),
        F.sum("_c").over(total).alias("n"),
        F.min("_min").over(total).alias("min"),
        F.max("_max").over(total).alias("max"),
    )
    wanted = F.array(
        *[
            F.struct(F.lit(name).alias("_q"), rank(F.col("n")).cast("bigint").alias("_r"))
            for name, rank in ranks.items()
        ]
    )
    targets = (
        placed.select("*", F.explode(wanted).alias("_w"))
        .where(
            (F.col("_w._r") > F.col("_before")) & (F.col("_w._r") <= F.col("_before") + F.col("_c"))
        )
        .groupBy(*keys, "_b")
        .agg(
            F.collect_list(
                F.struct(F.col("_w._q").alias("q"), (F.col("_w._r") - F.col("_before")).alias("r"))
            ).alias("_targets"),
            F.first("n").alias("n"),
            F.first("min").alias("min"),
            F.first("max").alias("max"),
        )
    )
    same = [F.col(f"f.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]
    same.append(F.col("f._b") == F.col("t._b"))
    hit = same[0]
    for clause in same[1:]:
        hit = hit & clause
    inside = fine.alias("f").join(targets.alias("t"), hit, "inner").select(
        *[F.col(f"f.{k}").alias(k) for k in keys], F.col("f._b").alias("_b"), F.col("f._v").alias("_v"),
        F.col("f._c").alias("_c"), "t._targets", "t.n", "t.min", "t.max",
    )
    within = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = inside.withColumn("_cum", F.sum("_c").over(within)).select(
        *keys, "_v", "_c", "_cum", "n", "min", "max", F.explode("_targets").alias("_t")
    )
    chosen = ranked.where(
        (F.col("_cum") >= F.col("_t.r")) & (F.col("_cum") - F.col("_c") < F.col("_t.r"))
    )
    out = chosen.groupBy(*keys).agg(
        F.first("n").alias("n"),
        F.first("min").alias("min"),
        F.first("max").alias("max"),
        *[F.max(F.when(F.col("_t.q") == name, F.col("_v"))).alias(name) for name in ranks],
    )
    return out.select(
        *[F.col(k).alias(g) for k, g in zip(keys, groups, strict=True)], "n", "min", "max", *ranks
    )


def nearest_rank(
    df: DataFrame, groups: Sequence[str], value: str, fractions: dict[str, float], bucket: float
) -> DataFrame:
    """Nearest-rank percentiles: the value at rank max(1, ceil(fraction * n))."""

    def rank(fraction: float) -> RankOf:
        return lambda n: F.greatest(F.lit(1), F.ceil(F.lit(fraction) * n))

    ranks = {name: rank(fraction) for name, fraction in fractions.items()}
    return order_statistics(df, groups, value, ranks, bucket)


def linear(
    df: DataFrame, groups: Sequence[str], value: str, fractions: dict[str, float], bucket: float
) -> DataFrame:
    """Linearly interpolated percentiles, from the two order statistics around each position."""

    def low(fraction: float) -> RankOf:
        return lambda n: F.floor(F.lit(fraction) * (n - 1)) + 1

    def high(fraction: float) -> RankOf:
        return lambda n: F.ceil(F.lit(fraction) * (n - 1)) + 1

    ranks: dict[str, RankOf] = {}
    for name, fraction in fractions.items():
        ranks[f"_lo_{name}"] = low(fraction)
        ranks[f"_hi_{name}"] = high(fraction)
    stats = order_statistics(df, groups, value, ranks, bucket)
    columns = {}
    for name, fraction in fractions.items():
        position = F.lit(fraction) * (F.col("n") - 1)
        a, b = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        columns[name] = a + (b - a) * (position - F.floor(position))
    return stats.withColumns(columns).select(*groups, "n", "min", "max", *fractions)
