"""Store contract: immutable revisions, as-of reads, accounting and coverage of the support."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnscope.functions.scalars import rounded


def publish(published: DataFrame, arriving: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """The rows a publication appends: the earliest arrival of every key not yet published.
    A retry of a published key adds nothing and keeps the published time."""
    first = arriving.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in arriving.columns if c not in keys]), at).alias("_r"))
    fresh = first.join(published.select(*keys), list(keys), "left_anti")
    return fresh.select(*keys, "_r.*")


def latest_per_scene(revisions: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Latest revision of each scene, combined map-side."""
    picked = F.max_by(F.struct(*order, *values), F.struct(*order)).alias("_r")
    return revisions.groupBy(*keys).agg(picked, F.count(F.lit(1)).alias("revisions")).select(*keys, "_r.*", "revisions")


def as_of(revisions: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], cutoff: Column) -> DataFrame:
    """What was queryable at a cutoff: the latest revision available by then."""
    return latest_per_scene(revisions.where(F.col(order[0]) <= cutoff), keys, order, values)


def exact_revision(revisions: DataFrame, revision: str, wanted: Column) -> DataFrame:
    return revisions.where(F.col(revision) == wanted)


def serve(
    revisions: DataFrame, bodies: DataFrame, body: str, *, period: tuple[Column, Column], time: str, families: Sequence[str], family: str,
    keys: Sequence[str], order: Sequence[str], values: Sequence[str], cutoff: Column,
) -> DataFrame:
    """Parameterized read: bodies, period, family and an as-of cutoff. The period is half-open and on the
    stored time, so that it reaches the scan; the bodies come in by a semi join."""
    chosen = revisions.where((F.col(time) >= period[0]) & (F.col(time) < period[1]) & F.col(family).isin(*families))
    chosen = chosen.join(bodies.select(body).distinct(), body, "left_semi")
    return as_of(chosen, keys, order, values, cutoff)


def account(expected: DataFrame, present: DataFrame, keys: Sequence[str], by: Sequence[str], reason: Column) -> DataFrame:
    """Expected, present, missing and reason counts. Nothing is dropped: a present record that
    was not expected is counted too."""
    tagged = expected.select(*keys, F.lit(1).alias("_e"), F.lit(0).alias("_p")).unionByName(
        present.select(*keys, F.lit(0).alias("_e"), F.lit(1).alias("_p"))
    )
    per_key = tagged.groupBy(*keys).agg((F.max("_e") == 1).alias("_e"), (F.max("_p") == 1).alias("_p"))
    missing = F.col("_e") & ~F.col("_p")
    return per_key.withColumn("_reason", F.when(missing, reason)).groupBy(*by).agg(
        F.count_if("_e").alias("expected"),
        F.count_if(F.col("_e") & F.col("_p")).alias("present"),
        F.count_if(missing).alias("missing"),
        F.count_if(~F.col("_e")).alias("unexpected"),
        F.min("_reason").alias("first_reason"),
        F.count_if(F.col("_reason") == "not_delivered").alias("not_delivered"),
    )


def missing_dates(spine: DataFrame, valid: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    """Dates of the spine on which the primary tile has no valid pixel, counted per body."""
    gone = spine.join(valid.select(*keys, date).distinct(), [*keys, date], "left_anti")
    return gone.groupBy(*keys).agg(F.count(F.lit(1)).alias("missing_dates"), F.min(date).alias("first"), F.max(date).alias("last"))


def mask_reason(value: Column, *, delivered: Column, in_tile: Column, nodata: Column, joined_has_data: Column) -> Column:
    """Why a pixel has no value, null when it has one."""
    return (
        F.when(~delivered, "not_delivered")
        .when(~in_tile, "outside_tile")
        .when((value == nodata) & F.coalesce(joined_has_data, F.lit(False)), "processor_masked")
        .when(value == nodata, "no_data")
    )


def support_coverage(pixels: DataFrame, tiles: DataFrame, cell: float) -> DataFrame:
    """Support pixels no tile covers and pixels several tiles cover, per body.

    Tiles are matched through square cells; a pixel meets the few tiles of its own cell. Pixels that are dealt by
    body stay where they are.
    """
    from tarnscope.operators.geometry import point_in_tiles

    hits = point_in_tiles(pixels.select("body", "x", "y"), tiles.select("tile", "west", "south", "east", "north"), cell, "left")
    per_pixel = hits.groupBy("body", "x", "y").agg(F.count("tile").alias("_n"))
    uncovered = F.count_if(F.col("_n") == 0)
    return per_pixel.groupBy("body").agg(
        F.count(F.lit(1)).alias("support"), uncovered.alias("uncovered"), F.count_if(F.col("_n") > 1).alias("overlap"),
        rounded(uncovered / F.count(F.lit(1)), 6).alias("uncovered_share"),
    )


def serve_bands(
    revisions: DataFrame, bodies: DataFrame, body: str, *, period: tuple[Column, Column], time: str, family: str, families: Sequence[str], band: str, bands: Sequence[str],
    resolution: str, resolutions: Sequence[int] = (), order: Sequence[str], values: Sequence[str], provenance: Sequence[str], cutoff: Column,
) -> tuple[DataFrame, DataFrame]:
    """The contract's read: the latest values by body, family and band as of a cutoff, each with where it
    comes from, and the account of the read.

    The account has a row per body and family asked for: how many bands were expected, present and missing,
    and which. A body without any value has a row too. No resolution named means all of them.
    """
    keys = [body, family, band, resolution]
    wanted = bodies.select(body).distinct()
    named = F.col(band).isin(*bands) & F.col(family).isin(*families)
    if resolutions:
        named = named & F.col(resolution).isin(*resolutions)
    rows = revisions.where((F.col(time) >= period[0]) & (F.col(time) < period[1]) & named).join(wanted, body, "left_semi")
    served = as_of(rows, keys, order, [*values, *provenance], cutoff)
    expected = wanted.withColumn(family, F.explode(F.array(*map(F.lit, families)))).withColumn(band, F.explode(F.array(*map(F.lit, bands))))
    have = served.select(body, family, band).distinct().withColumn("_have", F.lit(True))
    account = expected.join(have, [body, family, band], "left").groupBy(body, family).agg(
        F.count(F.lit(1)).alias("expected"), F.count("_have").alias("present"), F.count_if(F.col("_have").isNull()).alias("missing"),
        F.array_sort(F.collect_set(F.when(F.col("_have").isNull(), F.col(band)))).alias("missing_bands"),
    )
    return served, account


def in_primary_tile(valid: DataFrame, primary: DataFrame, body: str, tile: str) -> DataFrame:
    """Valid rows that lie in the primary tile of their body; what other tiles saw makes no date valid."""
    return valid.join(primary.select(body, tile).distinct(), [body, tile], "left_semi")


def shared_month_rates(first: DataFrame, second: DataFrame, first_months: DataFrame, second_months: DataFrame, tile: str, month: str) -> DataFrame:
    """Acquisitions of two products per tile, over the months that both surveys listed.

    ``first_months`` and ``second_months`` say which months of a tile each survey holds; one without any
    acquisition counts as zero, one that either survey lacks does not count at all.
    """
    keys = [tile, month]
    spine = first_months.select(*keys).distinct().join(second_months.select(*keys).distinct(), keys)
    tagged = spine.select(*keys, F.lit(0).alias("_a"), F.lit(0).alias("_b"), F.lit(1).alias("_s"))
    for rows, a, b in ((first, 1, 0), (second, 0, 1)):
        tagged = tagged.unionByName(rows.select(*keys, F.lit(a).alias("_a"), F.lit(b).alias("_b"), F.lit(0).alias("_s")))
    per_month = tagged.groupBy(*keys).agg(F.sum("_a").alias("a"), F.sum("_b").alias("b"), F.max("_s").alias("_s")).where("_s = 1")
    n = F.count(F.lit(1))
    return per_month.groupBy(tile).agg(
        n.alias("months"), F.sum("a").alias("first"), F.sum("b").alias("second"), (F.sum("a") * 12 / n).alias("first_per_year"), (F.sum("b") * 12 / n).alias("second_per_year"),
        F.try_divide(F.max("a"), F.sum("a") / n).alias("first_peak"), F.try_divide(F.max("b"), F.sum("b") / n).alias("second_peak"),
    )
