"""Summaries of runs in two levels, baselines, payload scaling and restricted snapshots."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnscope.operators.quantiles import linear


def spread_of_runs(runs: DataFrame, keys: Sequence[str], status: str, values: Sequence[str]) -> DataFrame:
    """Clean and excluded runs per key, with median, minimum and maximum of the clean ones. The
    repetitions of one key are few, so exact medians are bounded."""
    clean = F.col(status) == "ok"
    stats = [f(F.when(clean, F.col(v))).alias(f"{v}_{name}") for v in values for name, f in (("median", F.median), ("min", F.min), ("max", F.max))]
    return runs.groupBy(*keys).agg(F.count_if(clean).alias("runs"), F.count_if(~clean).alias("excluded"), *stats)


def medians_of_sums(bands: DataFrame, run: Sequence[str], keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Metrics of the bands of a run are summed, then the median over the runs of a key is taken."""
    per_run = bands.groupBy(*keys, *run).agg(*[F.sum(v).alias(v) for v in values])
    return per_run.groupBy(*keys).agg(F.count(F.lit(1)).alias("runs"), *[F.median(v).alias(v) for v in values])


def with_medians(groups: DataFrame, rows: DataFrame, keys: Sequence[str], values: dict[str, str], bucket: float) -> DataFrame:
    """``groups`` with the exact medians of ``values`` (column to result) of their rows. Few groups hold all rows,
    so the medians come from counts by bucket, not from the values of one group in one buffer."""
    for value, name in values.items():
        found = linear(rows, keys, value, {"_m": 0.5}, bucket).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_m").alias(name))
        same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
        groups = groups.join(found, same, "left").drop(*[f"_{k}" for k in keys])
    return groups


def medians_by_class(medians: DataFrame, size_class: str, values: Sequence[str], bucket: float = 64.0) -> DataFrame:
    """Second level: the median over bodies of a class of their own medians."""
    counts = medians.groupBy(size_class).agg(F.count(F.lit(1)).alias("bodies"))
    return with_medians(counts, medians, [size_class], {v: v for v in values}, bucket)


def baseline_sums(wanted: DataFrame, baseline: DataFrame, item: str, body: str, values: Sequence[str]) -> DataFrame:
    """Sums of earlier medians of an item's bodies, and how many bodies have none. The list of
    those bodies is kept, bounded by the bodies of one item."""
    joined = wanted.select(item, body).join(baseline.select(item, body, *values, F.lit(True).alias("_has")), [item, body], "left")
    absent = F.when(F.col("_has").isNull(), F.col(body))
    return joined.groupBy(item).agg(
        F.count("_has").alias("with_baseline"), F.array_sort(F.collect_list(absent)).alias("without"), *[F.sum(v).alias(v) for v in values]
    )


def payload_ratio(objects: DataFrame, keys: Sequence[str], size: str, native: str, measured: Column) -> DataFrame:
    """Object bytes over native bytes, of all layers and of the measured ones. Null without bytes."""
    out = {"all": F.lit(True), "measured": measured}
    sums = [F.sum(F.when(c, F.col(v))).alias(f"_{v}_{k}") for k, c in out.items() for v in (size, native)]
    ratios = {f"ratio_{k}": F.try_divide(F.col(f"_{size}_{k}"), F.nullif(F.col(f"_{native}_{k}"), F.lit(0))) for k in out}
    return objects.groupBy(*keys).agg(*sums).select(*keys, *[c.alias(k) for k, c in ratios.items()])


def payload_density(scenes: DataFrame, keys: Sequence[str], layers: str, native: str, area_km2: str) -> DataFrame:
    """Native bytes per square kilometre, and whether all scenes of a key hold the same layers."""
    agree = F.min(layers).eqNullSafe(F.max(layers))
    return scenes.groupBy(*keys).agg(agree.alias("layers_agree"), (F.sum(native) / F.sum(area_km2)).alias("bytes_per_km2"))


def transfer_estimate(plan: DataFrame, measured: DataFrame, keys: Sequence[str], members: str, per_member: str, settings: str, bucket: float = 256.0) -> DataFrame:
    """Bytes of a new plan: its memberships times the measured bytes of one. A configuration measured
    under other settings is refused with the reason in the row."""
    seen = measured.groupBy(*keys).agg(
        F.min(per_member).alias("_min"), F.max(per_member).alias("_max"),
        F.min(settings).alias("_low"), F.max(settings).alias("_high"),
    )
    seen = with_medians(seen, measured, keys, {per_member: "_median"}, bucket)
    joined = plan.join(seen, list(keys), "left")
    reason = (
        F.when(F.col("_low").isNull(), "not measured")
        .when((F.col("_low") != F.col(settings)) | (F.col("_high") != F.col(settings)), "other settings")
    )
    value = lambda c: F.when(reason.isNull(), F.col(members) * F.col(c))
    return joined.select(*keys, reason.alias("refused"), value("_median").alias("median"), value("_min").alias("low"), value("_max").alias("high"))


def restricted(catalog: DataFrame, keep: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Catalog rows that have a partner."""
    return catalog.join(keep.select(*keys).distinct(), list(keys), "left_semi")


def preferred_claims(candidates: DataFrame, claims: DataFrame, candidate: str, field: str, claim: str) -> DataFrame:
    """The claim bound to each candidate and field: one of the candidate's own id before the smallest
    other id. Fields without any claim stay, as gaps."""
    order = F.struct((F.col(claim) != F.col(candidate)).alias("other"), F.col(claim))
    bound = claims.groupBy(candidate, field).agg(F.min_by(claim, order).alias(claim), F.count(F.lit(1)).alias("sources"))
    joined = candidates.join(bound, [candidate, field], "left")
    return joined.select(candidate, field, claim, F.coalesce("sources", F.lit(0)).alias("sources"), F.col(claim).isNull().alias("gap"))


def nodata_for_nan(value: Column, nodata: Column) -> Column:
    """Whole numbers of a float layer; what is not a number becomes no-data, a broken value an error."""
    filled = F.when(F.isnan(value) | value.isNull(), nodata.cast("double")).otherwise(value)
    broken = F.raise_error(F.lit("value is no whole number")).cast("bigint")
    return F.when(filled == F.rint(filled), filled.cast("bigint")).otherwise(broken)
