"""Rows that must not pass: named reasons, and an error for a caller that asks for clean rows only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def refuse(rows: DataFrame, reason: str, names: Sequence[str]) -> DataFrame:
    """The rows as they are; one with a reason is an error that gives it and the row's names."""
    said = F.concat_ws(" ", F.concat(F.col(reason), F.lit(":")), *[F.col(n).cast("string") for n in names])
    return rows.withColumn(reason, F.when(F.col(reason).isNull(), F.lit(None).cast("string")).otherwise(F.raise_error(said).cast("string")))


def native_items(assets: DataFrame, item: Sequence[str], layer: Column, reason: Column) -> DataFrame:
    """``item, assets, problems, refused``: items whose assets all sit on the native grid have no problems. The
    problems name every layer with its reason, sorted; ``refused`` is null for an item that is admitted."""
    found = assets.select(*item, layer.alias("_layer"), reason.alias("_reason"))
    named = F.when(F.col("_reason").isNotNull(), F.concat_ws(" ", F.concat("_layer", F.lit(":")), "_reason"))
    out = found.groupBy(*item).agg(F.count(F.lit(1)).alias("assets"), F.array_sort(F.collect_set(named)).alias("problems"))
    return out.withColumn("refused", F.when(F.size("problems") > 0, "an asset has a different native grid"))


def replacement_attempts(audit: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, action, refused``: which attempts to repeat. Those that slept are replaced; complete ones that
    agree with the others stay; anything else is refused, as is an attempt that is not expected, not
    audited, or audited twice.

    ``audit`` has the keys, ``overlaps, complete, agrees``.
    """
    found = audit.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum("overlaps").alias("_overlaps"), F.bool_and("complete").alias("_complete"), F.bool_and("agrees").alias("_agrees"))
    both = expected.select(*keys).distinct().withColumn("_want", F.lit(True)).join(found, list(keys), "full_outer")
    whole = F.coalesce(F.col("_complete") & F.col("_agrees"), F.lit(False))
    refused = (
        F.when(F.col("_want").isNull(), "not expected").when(F.col("_n").isNull(), "not audited").when(F.col("_n") > 1, "audited twice")
        .when((F.col("_overlaps") == 0) & ~whole, "incomplete without sleep")
    )
    action = F.when(refused.isNotNull(), "review").when(F.col("_overlaps") > 0, "replace").otherwise("keep")
    return both.select(*keys, action.alias("action"), refused.alias("refused"))
