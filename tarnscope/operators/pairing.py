"""Product pairing: ranked and two-hop joins, scene grouping and tile choice per product."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def match_collections(
    scenes: DataFrame, items: DataFrame, keys: Sequence[str], *, product: str, baseline: str, rank: str, item: str
) -> DataFrame:
    """Match scenes to catalog items of the same keys, the first collection with any hit wins
    and hits of the scene's own baseline are preferred.

    Items are combined per key, collection and baseline before the join, so a key with very
    many items reaches the join as a handful of rows.
    """
    per_key = items.groupBy(*keys, rank, baseline).agg(
        F.count(F.lit(1)).alias("_n"), F.min(item).alias("_first")
    )
    same = F.col(f"s.{baseline}") == F.col(f"i.{baseline}")
    on = None
    for k in keys:
        clause = F.col(f"s.{k}") == F.col(f"i.{k}")
        on = clause if on is None else on & clause
    hits = scenes.alias("s").join(per_key.alias("i"), on, "left").select(
        F.col(f"s.{product}").alias(product), F.col(f"i.{rank}").alias("_rank"), same.alias("_same"), "_n", "_first"
    )
    per_rank = hits.groupBy(product, "_rank").agg(
        F.sum("_n").alias("hits"),
        F.sum(F.when(F.col("_same"), F.col("_n")).otherwise(0)).alias("same"),
        F.min(F.when(F.col("_same"), F.col("_first"))).alias("_same_first"),
        F.min("_first").alias("_any_first"),
    )
    best = per_rank.groupBy(product).agg(
        F.min_by(
            F.struct("_rank", "hits", "same", "_same_first", "_any_first"), F.coalesce("_rank", F.lit(2**31 - 1))
        ).alias("b")
    )
    status = (
        F.when(F.col("b._rank").isNull(), "none")
        .when(F.col("b.same") == 1, "exact")
        .when(F.col("b.same") > 1, "exact_multiple")
        .when(F.col("b.hits") == 1, "other_baseline")
        .otherwise("other_multiple")
    )
    return best.select(
        product,
        F.col("b._rank").alias("collection_rank"),
        status.alias("status"),
        F.coalesce(F.when(F.col("b.same") > 0, F.col("b.same")).otherwise(F.col("b.hits")), F.lit(0)).alias("joined"),
        F.coalesce(F.col("b._same_first"), F.col("b._any_first")).alias("first_item"),
    )


def joined_items(
    matches: DataFrame, scenes: DataFrame, items: DataFrame, keys: Sequence[str], *, product: str, baseline: str, rank: str, item: str
) -> DataFrame:
    """The joined item ids as rows: the items of the winning collection, of the scene's own
    baseline when any item has it."""
    chosen = scenes.join(matches.where(F.col("status") != "none"), product)
    exact = F.col("c.status").isin("exact", "exact_multiple")
    on = F.col(f"c.collection_rank") == F.col(f"i.{rank}")
    for k in keys:
        on = on & (F.col(f"c.{k}") == F.col(f"i.{k}"))
    pairs = chosen.alias("c").join(items.alias("i"), on)
    return pairs.where(~exact | (F.col(f"c.{baseline}") == F.col(f"i.{baseline}"))).select(
        F.col(f"c.{product}").alias(product), F.col(f"i.{item}").alias(item)
    )


def latest_created(items: DataFrame, keys: Sequence[str], *, created: str, item: str, weight: str | None = None, more: Sequence[str] = ()) -> DataFrame:
    """The latest created item per key, ties to the larger id, a missing time first. ``weight`` counts
    the items that a row already stands for, ``more`` are further columns of the latest."""
    order = F.struct(F.coalesce(F.col(created).cast("string"), F.lit("")).alias("c"), F.col(item).alias("i"))
    return items.groupBy(*keys).agg(
        F.max_by(F.col(item), order).alias("item"), (F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("candidates"),
        *[F.max_by(F.col(c), order).alias(c) for c in more],
    )


def datastrips_by_name(l1c: DataFrame, *, name: str, strip: str) -> DataFrame:
    """Distinct datastrip starts per Level-1C name: how many, and the one when single."""
    # Dealt by name at once: both groupings and a join by name find their rows in place.
    known = l1c.where(F.col(strip).isNotNull() & (F.length(name) > 0)).select(name, strip).repartition(name)
    distinct = known.groupBy(name, strip).agg(F.lit(1).alias("one"))
    return distinct.groupBy(name).agg(
        F.count(F.lit(1)).alias("strips"), F.min(strip).alias("datastrip")
    )


def pair_products(
    scenes: DataFrame,
    strips: DataFrame,
    c1_items: DataFrame,
    *,
    product: str,
    name: str,
    tile: str,
    platform: str,
    strip: str,
    created: str,
    item: str,
    weight: str | None = None,
) -> DataFrame:
    """Two-hop pairing: product to Level-1C name to datastrip to the latest created item.

    ``c1_items`` is reduced to one row per tile, platform and datastrip before it is joined.
    """
    latest = latest_created(c1_items, [tile, platform, strip], created=created, item=item, weight=weight)
    hop = scenes.join(strips, name, "left")
    single = F.when(F.col("strips") == 1, F.col("datastrip"))
    hop = hop.withColumn("datastrip", single)
    on = (
        (F.col(f"h.{tile}") == F.col(f"c.{tile}"))
        & (F.col(f"h.{platform}") == F.col(f"c.{platform}"))
        & (F.col("h.datastrip") == F.col(f"c.{strip}"))
    )
    joined = hop.alias("h").join(latest.alias("c"), on, "left")
    status = (
        F.when(F.col("h.strips").isNull(), "no_l1c_item")
        .when(F.col("h.strips") > 1, "l1c_ambiguous")
        .when(F.col("c.item").isNull(), "no_c1_item")
        .when(F.col("c.candidates") == 1, "datastrip")
        .otherwise("datastrip_multiple")
    )
    return joined.select(
        *[F.col(f"h.{c}") for c in scenes.columns],
        F.col("h.datastrip").alias("datastrip"),
        F.col("c.item").alias("c1_item"),
        F.greatest(F.coalesce(F.col("c.candidates"), F.lit(0)) - 1, F.lit(0)).alias("alternatives"),
        status.alias("pair_status"),
    )


def products_by_item(pairs: DataFrame, *, product: str, generation: str, complete: Column) -> DataFrame:
    """One product per item: the latest generation wins, others are superseded, and products
    missing a layer are recorded without a pairing."""
    full = complete & F.col("c1_item").isNotNull()
    order = F.struct(F.col(generation), F.col(product))
    # Products without an item are dealt by themselves, not all as one group of the missing item.
    item = Window.partitionBy("c1_item", F.when(F.col("c1_item").isNull(), F.col(product)))
    joined = pairs.withColumn("_winner", F.max(F.when(full, order)).over(item).getField(product))
    status = (
        F.when(~complete, "incomplete_layers")
        .when(F.col("c1_item").isNotNull() & (F.col(product) != F.col("_winner")), "superseded_same_datastrip")
        .otherwise(F.col("pair_status"))
    )
    return joined.select(
        product, F.when(complete, F.col("c1_item")).alias("c1_item"), status.alias("status")
    )


def pair_copies(items: DataFrame, *, copy: str, copies: tuple[str, str], uri: str, item: str, keys: Sequence[str]) -> DataFrame:
    """One item per copy and key, preferring the smallest shared product URI.

    Both copies are columns of one aggregation per URI, so they are never joined.
    """
    first, second = (F.min(F.when(F.col(copy) == c, F.col(item))) for c in copies)
    per_uri = items.groupBy(*keys, uri).agg(first.alias("_a"), second.alias("_b"))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    pair = F.struct(F.col(uri).alias("uri"), F.col("_a").alias("a"), F.col("_b").alias("b"))
    grouped = per_uri.groupBy(*keys).agg(
        F.min(F.when(both, pair)).alias("s"), F.min("_a").alias("_a"), F.min("_b").alias("_b")
    )
    shared = F.col("s").isNotNull()
    return grouped.select(
        *keys,
        F.when(shared, F.col("s.a")).otherwise(F.col("_a")).alias("first_item"),
        F.when(shared, F.col("s.b")).otherwise(F.col("_b")).alias("second_item"),
        F.when(shared, F.concat(F.lit("shared product "), F.col("s.uri").cast("string")))
        .otherwise("no shared product")
        .alias("note"),
    )


def group_scenes(
    objects: DataFrame, keys: Sequence[str], *, layer: str, obj: str, size: str, modified: str
) -> DataFrame:
    """Objects to scenes with a layer map. A repeated layer keeps its last-listed object.

    The first aggregation leaves one row per scene and layer, so the map is bounded by the
    number of layer names.
    """
    one = objects.groupBy(*keys, layer).agg(
        F.max(F.struct(F.col(obj), F.col(size), F.col(modified))).alias("_o"), F.min(modified).alias("_first"),
        F.max(modified).alias("_last"), F.count(F.lit(1)).alias("_n"),
    )
    return one.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(layer), F.col("_o"))))).alias("layers"),
        F.min("_first").alias("published_at"),
        F.max("_last").alias("last_modified"),
        F.sum("_n").alias("objects"),
        F.sum(F.col(f"_o.{size}")).alias("bytes"),
    )


def is_complete(layers: Column, wanted: Sequence[object]) -> Column:
    """The scene's layer map holds every wanted layer."""
    return F.size(F.array_except(F.array(*[F.lit(x) for x in wanted]), F.map_keys(layers))) == 0


def missing_layers(layers: Column, wanted: Sequence[object]) -> Column:
    return F.array_sort(F.array_except(F.array(*[F.lit(x) for x in wanted]), F.map_keys(layers)))


def first_complete_per_month(
    scenes: DataFrame, keys: Sequence[str], *, sensing: str, generation: str, product: str, complete: Column
) -> DataFrame:
    """Per key, the earliest complete scene, ties to the latest generation then product."""
    latest = F.when(complete, F.struct(F.col(generation), F.col(product)))
    per_sensing = scenes.groupBy(*keys, sensing).agg(
        F.count(F.lit(1)).alias("_listed"), F.count_if(complete).alias("_full"), F.max(latest).alias("_top")
    )
    first = F.when(F.col("_full") > 0, F.struct(F.col(sensing), F.col("_top"), F.col("_full")))
    return per_sensing.groupBy(*keys).agg(
        F.sum("_listed").alias("listed"),
        F.sum(F.col("_listed") - F.col("_full")).alias("incomplete"),
        F.min_by(first, F.when(F.col("_full") > 0, F.col(sensing))).alias("_f"),
    ).select(
        *keys,
        "listed",
        "incomplete",
        F.col(f"_f._top.{product}").alias("chosen"),
        F.coalesce(F.col("_f._full") - 1, F.lit(0)).alias("same_sensing"),
    )


def first_sensing(scenes: DataFrame, keys: Sequence[str], sensing: str) -> DataFrame:
    """All products of the first sensing per key. The rank filter is pushed below the shuffle
    as a group limit, so only the leading rows of each task travel."""
    order = Window.partitionBy(*keys).orderBy(sensing)
    return scenes.withColumn("_r", F.rank().over(order)).where("_r = 1").drop("_r")


def best_covering_item(
    items: DataFrame, keys: Sequence[str], *, covered: str, cloud: str, created: Column, item: str
) -> DataFrame:
    """Per key the item covering most members, then lowest cloud (missing last), then latest
    created, then the larger id."""
    order = F.struct(
        F.col(covered), -F.coalesce(F.col(cloud).cast("double"), F.lit(float("inf"))), created, F.col(item)
    )
    return items.groupBy(*keys).agg(
        F.max_by(F.struct(item, covered, cloud), order).alias("b"), F.count(F.lit(1)).alias("candidates")
    ).select(*keys, f"b.{item}", f"b.{covered}", f"b.{cloud}", "candidates")


def merge_choices(df: DataFrame, keys: Sequence[str], member: str, order: str) -> DataFrame:
    """Merge per-region choices: one row per key and member, the first occurrence wins."""
    return df.groupBy(*keys, member).agg(F.min(order).alias(order), F.count(F.lit(1)).alias("choices"))
