"""Iterative selections: greedy covers, spread samples, connected groups, quotas and plans.

Every loop works on a table reduced first and advances all regions together. State between
rounds is checkpointed to the shared folder, so a lost executor costs one round.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnscope.operators.geometry import by_shuffle
from tarnscope.session import cut_lineage


def cover_signatures(pairs: DataFrame, region: str, chooser: str, element: str) -> DataFrame:
    """Elements with the text of all sets that can cover them. Elements of one region with the
    same sets are interchangeable in a cover. A set list is bounded by the sets of a region."""
    sets = pairs.groupBy(region, element).agg(F.array_sort(F.collect_set(chooser)).alias("_sets"))
    return sets.select(region, element, F.array_join(F.col("_sets").cast("array<string>"), ",").alias("signature"))


def greedy_cover(
    pairs: DataFrame, region: str, chooser: str, element: str, merges: dict[str, Column], combine: dict[str, str], rank: Sequence[Column]
) -> DataFrame:
    """Greedy set cover of every region at once.

    Each round a region chooses the set that covers most uncovered elements, ties broken by
    ``rank`` (smallest wins) and then by the smaller set id. ``merges`` are aggregates over one
    set's elements and ``combine`` says how two such values merge (sum, max or min). Rounds run
    on element signatures, whose number does not grow with the elements. Returns the sets in
    order with the elements they newly cover.
    """
    listed = cover_signatures(pairs, region, chooser, element)
    rows = pairs.join(listed, [region, element])
    state = cut_lineage(
        rows.groupBy(region, chooser, "signature").agg(
            F.count_distinct(element).alias("n"), *[c.alias(name) for name, c in merges.items()]
        )
    )
    fold = {"sum": F.sum, "max": F.max, "min": F.min}
    chosen, round_no = None, 0
    while not state.isEmpty():
        round_no += 1
        scores = state.groupBy(region, chooser).agg(
            F.sum("n").alias("n"), *[fold[how](name).alias(name) for name, how in combine.items()]
        )
        order = F.struct(-F.col("n"), *rank, F.col(chooser))
        winners = scores.groupBy(region).agg(F.min_by(F.struct(*scores.columns[1:]), order).alias("w")).select(region, "w.*")
        winners = cut_lineage(winners.withColumn("round", F.lit(round_no)))
        chosen = winners if chosen is None else chosen.unionByName(winners)
        covered = state.join(winners.select(region, chooser), [region, chooser]).select(region, "signature")
        state = cut_lineage(state.join(covered, [region, "signature"], "left_anti"))
    if chosen is None:
        raise ValueError("nothing to cover")
    return chosen


def cover_assignments(chosen: DataFrame, pairs: DataFrame, region: str, chooser: str, element: str, wanted: DataFrame | None = None) -> DataFrame:
    """The set every element was assigned to: the first chosen one that can cover it.

    With ``wanted``, the elements that must be covered, one that no set covers is an error.
    """
    usable = pairs.join(chosen.select(region, chooser, "round"), [region, chooser])
    assigned = usable.groupBy(region, element).agg(
        F.min_by(chooser, "round").alias(chooser), F.min("round").alias("round")
    )
    if wanted is None:
        return assigned
    missing = F.raise_error(F.concat(F.lit("no set covers "), F.col(element).cast("string"))).cast(assigned.schema[chooser].dataType)
    every = wanted.select(region, element).distinct().join(assigned, [region, element], "left")
    return every.withColumn(chooser, F.when(F.col("round").isNotNull(), F.col(chooser)).otherwise(missing))


def spread_sample(
    candidates: DataFrame, stratum: str, item: str, x: str, y: str, band: str, bands: Sequence[str], key: Column, count: int
) -> DataFrame:
    """Round-robin sample: each round every stratum takes the candidate farthest from those it
    already has, preferring the round's band, hash ties; the last round is cut in stratum order.

    ``count`` is the sample size asked for. Candidates are scanned once per round and compared
    only with the few points their stratum already holds.
    """
    base = candidates.select(stratum, item, x, y, band, key.alias("_key"))
    chosen: DataFrame | None = None
    total, round_no = 0, 0
    while total < count:
        wanted = bands[round_no % len(bands)]
        pool = base
        if chosen is None:
            pool = pool.withColumn("_d", F.lit(0.0))
        else:
            held = chosen.groupBy(stratum).agg(
                F.collect_list(F.struct(F.col(x).alias("px"), F.col(y).alias("py"), F.col(item).alias("pi"))).alias("_held")
            )
            pool = pool.join(held, stratum, "left").where(
                F.col("_held").isNull() | ~F.exists("_held", lambda h: h.pi == F.col(item))
            )
            scale = F.cos(F.radians(F.col(y)))
            dist = F.transform("_held", lambda h: F.pow((F.col(x) - h.px) * scale, 2) + F.pow(F.col(y) - h.py, 2))
            pool = pool.withColumn("_d", F.coalesce(F.array_min(dist), F.lit(0.0)))
        order = F.struct((F.col(band) != wanted).cast("int"), -F.col("_d"), F.col("_key"), F.col(item))
        picked = pool.groupBy(stratum).agg(F.min_by(F.struct(item, x, y, band), order).alias("p")).select(stratum, "p.*")
        round_no += 1
        picked = cut_lineage(picked.withColumn("round", F.lit(round_no)))
        taken = picked.count()
        if taken == 0:
            raise ValueError("not enough candidates for the sample")
        if total + taken > count:
            picked = cut_lineage(picked.orderBy(stratum).limit(count - total))
            taken = count - total
        chosen = picked if chosen is None else chosen.unionByName(picked)
        total += taken
    return chosen


def connected_groups(edges: DataFrame, node: str, link: str) -> DataFrame:
    """Nodes that share links, directly or in chain, labelled by their smallest node.

    Each round a node takes the smallest label around its links, then the label of that label,
    which shortens chains. Label tables are checkpointed each round. Both sides of every join grow with the nodes, so
    none goes whole through the driver.
    """
    links = edges.select(node, link).distinct()
    labels = cut_lineage(links.groupBy(node).agg(F.min(node).alias("label")))
    while True:
        around = links.join(by_shuffle(labels), node).groupBy(link).agg(F.min("label").alias("_m"))
        near = links.join(by_shuffle(around), link).groupBy(node).agg(F.min("_m").alias("_near"))
        jump = labels.select(F.col(node).alias("_near"), F.col("label").alias("_far"))
        moved = near.join(by_shuffle(jump), "_near", "left").select(node, F.least("_near", F.coalesce("_far", "_near")).alias("label"))
        moved = cut_lineage(moved)
        changed = moved.join(by_shuffle(labels.withColumnRenamed("label", "_old")), node).where(F.col("label") != F.col("_old"))
        done = changed.isEmpty()
        labels = moved
        if done:
            return labels


def quotas(available: DataFrame, band: str, n: str, position: str, count: int) -> DataFrame:
    """Balance a sample over bands, a short band's share going to the others in turn.

    The k-th item of a band is taken before the k+1-th of any, so the quota is the number of a
    band's items among the first ``count`` in (k, band position) order. Only the counts of the
    bands are needed, and no more than ``count`` of each.
    """
    ladder = available.select(band, position, F.explode(F.sequence(F.lit(1), F.least(F.col(n), F.lit(count)).cast("int"))).alias("_k"))
    first = ladder.orderBy("_k", position).limit(count)
    return first.groupBy(band).agg(F.count(F.lit(1)).alias("quota"))


def nearest_by_class(candidates: DataFrame, keys: Sequence[str], width: str, source: str, classes: Sequence[int]) -> DataFrame:
    """The candidate of each size class whose width is nearest by absolute log ratio."""
    expanded = candidates.select(*keys, width, source, F.explode(F.array(*[F.lit(c) for c in classes])).alias("size_class"))
    ratio = F.abs(F.ln(F.col(width) / F.col("size_class")))
    return expanded.groupBy(*keys, "size_class").agg(
        F.min_by(F.struct(source, width), F.struct(F.round(ratio, 12), F.col(source))).alias("b")
    ).select(*keys, "size_class", f"b.{source}", f"b.{width}")


def plan_rows(members: DataFrame, keys: Sequence[str], patterns: Sequence[str], methods: Sequence[str], repeat: int) -> DataFrame:
    """Every member times repetition, pattern and method, both lists rotated by repetition.

    The lists are constants of the plan, so they are expanded inside each row.
    """
    from tarnscope.functions.scalars import rotated

    lists = members.select(
        *keys, F.explode(F.sequence(F.lit(1), F.lit(repeat))).alias("repetition")
    ).withColumns(
        {
            "_p": rotated(F.array(*[F.lit(p) for p in patterns]), F.col("repetition") - 1),
            "_m": rotated(F.array(*[F.lit(m) for m in methods]), F.col("repetition") - 1),
        }
    )
    rows = lists.select(*keys, "repetition", "_m", F.posexplode("_p").alias("_i", "pattern"))
    rows = rows.select(*keys, "repetition", "pattern", "_i", F.posexplode("_m").alias("_j", "method"))
    return rows.select(*keys, "repetition", "pattern", "method", (F.col("_i") * len(methods) + F.col("_j")).alias("position"))


def worst_if_unknown(cloud: str) -> Column:
    """Cloud cover for a ranking, infinite where it is unknown."""
    return F.coalesce(F.col(cloud).cast("double"), F.lit(float("inf")))


def rank_datatakes(items: DataFrame, *, region: str, group: str, identity: Sequence[str], created: str, item: str, cloud: str, sensing: str, uncovered: str) -> DataFrame:
    """Best datatake per region: the latest revision of each observation stands for it, then
    smallest uncovered share, lowest cloud (missing last), latest earliest sensing, smaller id."""
    revision = items.groupBy(region, group, *identity).agg(
        F.min_by(F.struct(item, cloud, sensing, uncovered), F.struct(-F.unix_micros(F.col(created).cast("timestamp")), F.col(item))).alias("r"),
        (F.count(F.lit(1)) - 1).alias("discarded"),
    )
    scored = revision.groupBy(region, group).agg(
        F.max(f"r.{uncovered}").alias("uncovered"),
        F.when(F.count_if(F.col(f"r.{cloud}").isNull()) == 0, F.max(f"r.{cloud}")).alias("cloud"),
        F.min(f"r.{sensing}").alias("earliest"),
        F.count(F.lit(1)).alias("items"),
        F.sum("discarded").alias("discarded"),
    )
    late = -F.unix_micros(F.col("earliest").cast("timestamp"))
    order = F.struct(F.col("uncovered"), worst_if_unknown("cloud"), late, F.col(group))
    best = scored.groupBy(region).agg(F.min_by(F.struct(group, "uncovered", "cloud", "items", "discarded"), order).alias("b"))
    return best.select(region, "b.*")


def require_one(df: DataFrame, keys: Sequence[str], condition: Column, message: str) -> DataFrame:
    """Count rows that meet a condition per key; another number than one is an error."""
    counted = df.groupBy(*keys).agg(F.count_if(condition).alias("n"))
    return counted.withColumn("n", F.when(F.col("n") == 1, F.col("n")).otherwise(F.raise_error(F.lit(message)).cast("bigint")))
