"""Run status, timers, reuse decisions and frozen-input checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def run_status(*, memory_stop: Column, error: Column, band_errors: Column, pixels: Column | None = None) -> Column:
    """stopped_for_memory, failed, no_pixel_in_tile, band_errors or ok, tested in this order."""
    status = F.when(F.coalesce(memory_stop, F.lit(False)), "stopped_for_memory").when(error.isNotNull(), "failed")
    if pixels is not None:
        status = status.when(pixels == 0, "no_pixel_in_tile")
    return status.when(band_errors > 0, "band_errors").otherwise("ok")


def sum_timers(items: Column, fields: Sequence[str]) -> Column:
    """Sum of timer fields over an array of records, missing ones as zero."""

    def one(e: Column) -> Column:
        total = F.lit(0.0)
        for f in fields:
            total = total + F.coalesce(e.getField(f), F.lit(0.0))
        return total

    return F.round(F.aggregate(F.transform(items, one), F.lit(0.0), lambda a, b: a + b), 3)


def blocks_touched(items: Column, field: str) -> Column:
    """Sum of a field over an array of records, null when any is unknown."""
    values = F.transform(items, lambda e: e.getField(field))
    total = F.aggregate(values, F.lit(0).cast("bigint"), lambda a, b: a + b)
    return F.when(~F.exists(values, lambda v: v.isNull()), total)


def first_mismatch(saved: str, wanted: str, keys: Sequence[str]) -> Column:
    """First key on which a saved specification differs from the wanted one, null when none."""
    out = F.when(F.lit(False), F.lit(""))
    for key in keys:
        out = out.when(~F.col(f"{saved}.{key}").eqNullSafe(F.col(f"{wanted}.{key}")), F.lit(key))
    return out.otherwise(F.lit(None).cast("string"))


def reuse_decision(wanted: DataFrame, saved: DataFrame, unit: Sequence[str], keys: Sequence[str], error: str | None = None) -> DataFrame:
    """Reuse a saved result when its specification matches, else the reason not to."""
    on = None
    for u in unit:
        clause = F.col(f"w.{u}") == F.col(f"s.{u}")
        on = clause if on is None else on & clause
    joined = wanted.alias("w").join(saved.alias("s"), on, "left")
    absent = F.col(f"s.{unit[0]}").isNull()
    reason = F.when(absent, "nothing saved")
    if error is not None:
        reason = reason.when(F.col(f"s.{error}").isNotNull(), "saved run has errors")
    reason = reason.otherwise(first_mismatch("s", "w", keys))
    return joined.select(*[F.col(f"w.{u}").alias(u) for u in unit], reason.alias("reason"), reason.isNull().alias("reuse"))


def changed_digests(manifest: DataFrame, found: DataFrame, key: str, digest: str) -> DataFrame:
    """Artifacts whose content no longer matches the recorded digest, or that are gone."""
    joined = manifest.withColumnRenamed(digest, "_want").join(found.withColumnRenamed(digest, "_have"), key, "left")
    state = F.when(F.col("_have").isNull(), "gone").when(F.col("_want") != F.col("_have"), "changed")
    return joined.withColumn("state", state).where(F.col("state").isNotNull()).select(key, "state")


def require_same_digest(manifest: DataFrame, found: DataFrame, key: str, digest: str) -> DataFrame:
    """The found rows, refused with an error where the digest differs from the manifest."""
    joined = found.join(manifest.select(key, F.col(digest).alias("_want")), key)
    ok = F.when(F.col(digest) == F.col("_want"), F.col(digest)).otherwise(
        F.raise_error(F.concat(F.lit("digest changed: "), F.col(key).cast("string")))
    )
    return joined.withColumn(digest, ok).drop("_want")


def uniqueness(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def medians_of_clean_runs(runs: DataFrame, keys: Sequence[str], status: str, values: Sequence[str]) -> DataFrame:
    """Medians over clean repetitions with the number of runs left out.

    Repetitions of one combination are few by plan, so a built-in median is used.
    """
    clean = F.col(status) == "ok"
    return runs.groupBy(*keys).agg(
        F.count_if(clean).alias("runs"), F.count_if(~clean).alias("excluded"),
        *[F.median(F.when(clean, F.col(v))).alias(v) for v in values],
    )


def equal_digests(rows: DataFrame, keys: Sequence[str], digest: str, method: str) -> DataFrame:
    """Do all methods give one digest. A missing digest is a difference, not ignored."""
    value = F.coalesce(F.col(digest), F.lit("missing"))
    return rows.groupBy(*keys).agg(
        F.count_distinct(method).alias("methods"), F.count_distinct(value).alias("digests"), (F.count_distinct(value) == 1).alias("equal")
    )


def bind_claims(drafts: DataFrame, checks: DataFrame, claim: str, verdict: str) -> DataFrame:
    """Drafts bound to their checks: confirmed and corrected ones are bound, others are gaps
    with a reason. A claim checked twice is a gap of its own kind."""
    counted = checks.groupBy(claim).agg(F.count(F.lit(1)).alias("_n"), F.min(verdict).alias(verdict))
    joined = drafts.join(counted, claim, "left")
    reason = (
        F.when(F.col("_n").isNull(), "not checked").when(F.col("_n") > 1, "checked twice")
        .when(~F.col(verdict).isin("confirmed", "corrected"), F.col(verdict))
    )
    return joined.withColumn("gap_reason", reason).withColumn("bound", reason.isNull()).drop("_n")


def accept_source_change(changes: DataFrame, attempts: DataFrame, unit: str, reason: str) -> DataFrame:
    """Lineage rows of accepted source changes. A change without a reason, or after an
    extraction was attempted for its unit, is refused with the cause in the row."""
    tried = attempts.select(unit).distinct().withColumn("_tried", F.lit(True))
    joined = changes.join(tried, unit, "left")
    cause = F.when(F.coalesce(F.trim(F.col(reason)), F.lit("")) == "", "no reason given").when(F.col("_tried"), "already extracted")
    return joined.withColumn("refused", cause).withColumn("accepted", cause.isNull()).drop("_tried")
