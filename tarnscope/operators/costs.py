"""Cost and capacity estimates as columns over scenario rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GIB = 1024**3
TIER_LIMITS_GIB = (50 * 1024, 500 * 1024)
DAYS_PER_YEAR = 365.25


def storage_price(gib: Column, rates: Sequence[float]) -> Column:
    """Marginal three-tier monthly price of binary gigabytes."""
    first, second = TIER_LIMITS_GIB
    return (
        F.least(gib, F.lit(float(first))) * rates[0]
        + F.least(F.greatest(gib - first, F.lit(0.0)), F.lit(float(second - first))) * rates[1]
        + F.greatest(gib - second, F.lit(0.0)) * rates[2]
    )


def occupancy(draws: Column, cells: Column, fraction: Column, mass: Column) -> Column:
    """Expected distinct cells hit under two density strata."""

    def stratum(f: Column, m: Column) -> Column:
        capacity = cells * f
        return capacity * -F.expm1(-draws * m / capacity)

    return stratum(fraction, mass) + stratum(1 - fraction, 1 - mass)


def fit_mass(draws: Column, cells: Column, fraction: Column, target: Column, steps: int = 60) -> Column:
    """Bisection for the concentrated mass whose occupancy meets a target, inside the row."""
    start = F.struct(fraction.cast("double").alias("lo"), F.lit(1.0).alias("hi"))

    def step(state: Column, _i: Column) -> Column:
        middle = (state.lo + state.hi) / 2
        over = occupancy(draws, cells, fraction, middle) > target
        return F.struct(F.when(over, middle).otherwise(state.lo).alias("lo"), F.when(over, state.hi).otherwise(middle).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: (s.lo + s.hi) / 2)


def interpolate(x: Column, low: tuple[float, float], high: tuple[float, float]) -> Column:
    """Linear between two anchors, clamped to them."""
    weight = F.least(F.greatest((x - low[0]) / (high[0] - low[0]), F.lit(0.0)), F.lit(1.0))
    return F.lit(low[1]) + weight * (high[1] - low[1])


def object_count(history: Column, months: Column, tiles: Column, grids: int, target: float, layout: str) -> Column:
    """Objects of the history under one of two layouts."""
    groups = F.lit(grids) * F.ceil(months)
    if layout == "tile_month":
        return F.ceil(F.greatest(groups * tiles, history / target))
    return groups * F.greatest(F.lit(1), F.ceil(history / groups / target))


def acquisition_rate(complete: Column, tail_days: Column, recent_annual: Column, days: Column) -> Column:
    """Annual rate over a dated window whose last days are extrapolated at the recent rate."""
    return (complete + tail_days * recent_annual / DAYS_PER_YEAR) / days * DAYS_PER_YEAR


def close_population(bins: DataFrame, scenario: Sequence[str], position: str, count: str, mean: str, total: str, area: str) -> DataFrame:
    """Close area bins on a total count and area: the first bin takes the remaining bodies and
    the last bin's mean takes the remaining area. An impossible remainder is an error."""
    first = F.col(position) == 1
    sums = bins.groupBy(*scenario).agg(
        F.sum(F.when(~first, F.col(count)).otherwise(0)).alias("_rest"), F.max(position).alias("_last"),
        F.max(total).alias("_total"), F.max(area).alias("_area"),
    )
    joined = bins.join(sums, list(scenario))
    closed = joined.withColumn("_c", F.when(first, F.col("_total") - F.col("_rest")).otherwise(F.col(count)))
    last = F.col(position) == F.col("_last")
    known = closed.groupBy(*scenario).agg(F.sum(F.when(~last, F.col("_c") * F.col(mean)).otherwise(0.0)).alias("_known"))
    out = closed.join(known, list(scenario))
    value = F.when(last, (F.col("_area") - F.col("_known")) / F.col("_c")).otherwise(F.col(mean))
    ok = (F.col("_c") > 0) & (value > 0)
    fail = F.raise_error(F.lit("bins cannot be closed")).cast("double")
    return out.select(*scenario, position, F.col("_c").alias(count), F.when(ok, value).otherwise(fail).alias(mean))


def retained_estimate(df: DataFrame) -> DataFrame:
    """Retained pixels and bytes of scenario rows.

    Columns in: bodies, water_km2, perimeter_km, radius_km, resolution_m, value_bytes,
    flag_bytes, overlap, membership, metadata_bytes, multiplier, compression, acquisitions.
    """
    c = {name: F.col(name) for name in df.columns}
    r = c["resolution_m"] / 1000.0
    buffer = c["radius_km"] * c["perimeter_km"] + math.pi * c["radius_km"] * c["radius_km"] * c["bodies"]
    shore = c["water_km2"] / (r * r) + 2 * c["perimeter_km"] / (r * math.pi) + c["bodies"]
    pixels = F.greatest(shore, (c["water_km2"] + buffer) / (r * r))
    raw = pixels * (c["value_bytes"] + c["flag_bytes"]) * c["overlap"] + c["bodies"] * c["membership"] * c["metadata_bytes"]
    epoch = raw * c["multiplier"] / c["compression"]
    return df.withColumns({"pixels": pixels, "epoch_bytes": epoch, "history_bytes": epoch * c["acquisitions"]})


def forecast_storage(df: DataFrame, history: str, monthly: str, months: Column, rates: Sequence[float]) -> DataFrame:
    """Month-by-month retained bytes and price of every scenario, and the cumulative cost.

    A month's price follows from its number, so the running cost is a sum over the months of one
    row; nothing is joined.
    """

    def price(volume: Column) -> Column:
        return storage_price(volume / float(GIB), rates)

    def at(m: Column) -> Column:
        return F.struct(
            m.alias("month"),
            price(F.col(history) + m * F.col(monthly)).alias("end_price"),
            price(F.col(history) + (m - 0.5) * F.col(monthly)).alias("accrued"),
        )

    listed = F.transform(F.sequence(F.lit(1), months), at)
    total = F.aggregate(listed, F.lit(0.0), lambda acc, e: acc + e.accrued)
    return df.withColumns(
        {"end_month_price": F.element_at(listed, -1).end_price, "cumulative_price": total, "retained_gib": (F.col(history) + months * F.col(monthly)) / float(GIB)}
    )


def tiered_cost(df: DataFrame, volume: str, age_days: str, object_bytes: str, *, minimum: float, warm_days: int, cold_days: int, warm_rate: float, cold_rate: float, rates: Sequence[float]) -> DataFrame:
    """Storage-class split of aging volumes and its cost, and the break-even with one class."""
    gib = F.col(volume) / float(GIB)
    eligible = F.col(object_bytes) >= minimum
    warm = eligible & (F.col(age_days) >= warm_days) & (F.col(age_days) < cold_days)
    cold = eligible & (F.col(age_days) >= cold_days)
    standard = storage_price(gib, rates)
    tiered = F.when(cold, gib * cold_rate).when(warm, gib * warm_rate).otherwise(standard)
    name = F.when(cold, "cold").when(warm, "warm").otherwise("frequent")
    return df.withColumns({"storage_class": name, "standard_price": standard, "tiered_price": tiered, "cheaper": tiered < standard})


def sensitivities(df: DataFrame, inputs: Sequence[str], factors: Sequence[float], estimate) -> DataFrame:
    """Vary one input at a time. Variants are expanded inside the row and estimated in one pass;
    ``estimate`` is the caller's DataFrame to DataFrame function."""
    variants = F.array(*[F.struct(F.lit(i).alias("varied"), F.lit(float(f)).alias("factor")) for i in inputs for f in factors])
    rows = df.withColumn("_v", F.explode(variants)).select("*", "_v.varied", "_v.factor").drop("_v")
    scaled = {i: F.when(F.col("varied") == i, F.col(i) * F.col("factor")).otherwise(F.col(i)) for i in inputs}
    return estimate(rows.withColumns(scaled))


def overlay(base: Column, overrides: Column) -> Column:
    """Shared settings with an option's overrides laid over them."""
    kept = F.map_filter(base, lambda k, _v: ~F.array_contains(F.map_keys(overrides), k))
    return F.map_concat(kept, overrides)
