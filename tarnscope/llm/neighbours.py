"""Embedding near-deduplication by NN-descent."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnscope.llm.common import _PLACES, mix, smallest_labels, written

NEIGHBOURS = 12
TREES, LEAF = 8, 100
BLOCK = 512
AUDIT, RECALL, ROUNDS = 400, 0.998, 6
BUCKET_ROWS = 60_000
# Centers of components that meet in one block, blocks at least, and what angles may be off by rounding.
CENTERS, CENTER_PARTS, SLACK = 4096, 8, 1e-6
_BITS = np.uint64(1) << np.arange(63, dtype=np.uint64)


def _valid(column: str):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(column).to_pylist():
                ok = value is not None and len(value) and None not in value
                x = np.array(value if ok else [], np.float64)
                ok = ok and np.isfinite(x).all() and x.any() and 0 < x @ x < np.inf
                out.append(x.tobytes() if ok else None)
            yield pa.record_batch({"vec_id": batch.column("vec_id"), "vector": pa.array(out, pa.binary())})

    return pack


def matrix(vectors: list[bytes]) -> np.ndarray:
    """Unit vectors in double precision, one row each."""
    x = np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _codes(bits: int):
    """Leaf of every vector in each of several trees of random hyperplanes."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            rows = []
            for value in batch.column("vector").to_pylist():
                x = np.frombuffer(value, np.float64)
                if len(x) not in planes:
                    planes[len(x)] = np.random.default_rng(len(x)).standard_normal((TREES, bits, len(x)))
                sides = planes[len(x)] @ x > 0
                rows.append([int(mix(np.array([side @ _BITS[:bits], t, len(x)], np.uint64) * _PLACES[:3]).sum() >> np.uint64(1)) for t, side in enumerate(sides)])
            yield pa.record_batch({"node": batch.column("node"), "codes": pa.array(rows, pa.list_(pa.int64()))})

    return code


def best_of(sims: np.ndarray, floors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k largest entries of every row that exceed the row's floor."""
    if sims.shape[1] > k:
        cut = np.partition(sims, sims.shape[1] - k, axis=1)[:, sims.shape[1] - k]
        floors = np.maximum(floors, np.nextafter(cut, -2))
    return np.nonzero(sims > floors[:, None])


def _compare(k: int):
    """Compare all members of each group of a bucket; a pair is returned to a member whose list it
    would enter."""

    def compare(table: pa.Table) -> pa.Table:
        groups = table.column("group").to_numpy()
        order = np.argsort(groups, kind="stable")
        nodes, floors = table.column("node").to_numpy()[order], table.column("floor").to_numpy()[order]
        vectors = table.column("vector").to_pylist()
        out = []
        for rows in np.split(np.arange(len(order)), np.flatnonzero(np.diff(groups[order])) + 1):
            ids, first = np.unique(nodes[rows], return_index=True)
            if len(ids) < 2:
                continue
            x = matrix([vectors[order[rows[i]]] for i in first])
            sims = x @ x.T
            np.fill_diagonal(sims, -2)
            a, b = best_of(sims, floors[rows[first]], k)
            out.append((ids[a], ids[b], sims[a, b]))
        a, b, s = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"node": a, "other": b, "sim": s})

    return compare


def bucketed(rows: DataFrame, k: int) -> DataFrame:
    """``rows`` (``group, node, floor, vector``) compared group by group, many groups to a bucket."""
    buckets = max(16, ceil(rows.count() / BUCKET_ROWS))
    keyed = rows.withColumn("bucket", F.pmod("group", F.lit(buckets)))
    return keyed.groupBy("bucket").applyInArrow(_compare(k), "node long, other long, sim double")


def salted(rows: DataFrame, key: str, size: int) -> DataFrame:
    """Split keys with more than ``size`` rows evenly; ``group`` tells the parts apart."""
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    part = F.pmod(F.xxhash64("node", key), F.ceil(F.col("_n") / size))
    return rows.join(counts, key).withColumn("group", F.xxhash64(key, part)).drop("_n")


def shortened(pairs: DataFrame, k: int) -> DataFrame:
    """The k most similar others of every node, as an array of ``sim, other``."""
    some = pairs.select("node", F.struct("sim", "other").alias("near")).distinct()
    return some.groupBy("node").agg(F.slice(F.sort_array(F.collect_list("near"), False), 1, k).alias("near"))


def descend(lists: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """One round: every node's neighbours and reverse neighbours are compared with each other. All
    reverse neighbours take part, those of a hub in several groups."""
    edges = lists.select("node", F.explode("near").alias("near")).select("node", F.col("near.other").alias("other"), F.col("near.sim").alias("sim"))
    around = edges.select(F.col("node").alias("hub"), F.col("other").alias("node")).union(edges.select(F.col("other").alias("hub"), "node"))
    groups = salted(around.distinct(), "hub", 3 * k).select("group", "node")
    floor = F.when(F.size("near") >= k, F.element_at("near", -1)["sim"]).otherwise(-2.0)
    floors = vectors.join(lists, "node", "left").select("node", "vector", F.coalesce(floor, F.lit(-2.0)).alias("floor"))
    fresh = bucketed(written(groups.join(floors, "node").select("group", "node", "floor", "vector"), "around"), k)
    return written(shortened(edges.union(edges.select("other", "node", "sim")).union(fresh), k), "lists")


def saturated(least: float) -> Column:
    """Whether a list is full of links, so that further links may have found no room in it."""
    return F.coalesce((F.size("near") >= NEIGHBOURS) & (F.element_at("near", -1)["sim"] >= least), F.lit(False))


def audit(lists: DataFrame, vectors: DataFrame, least: float) -> float:
    """Share of the links of some vectors, chosen by a hash, that are in a list of one of their two nodes,
    or that ``block_counts`` and ``across`` count since both lists are saturated."""
    share = F.pmod(F.xxhash64("node"), F.lit(1_000_003)) < int(1_000_003 * min(1.0, 4 * AUDIT / max(vectors.count(), 1)))
    some = vectors.where(share).orderBy(F.xxhash64("node")).limit(AUDIT).collect()
    by_size: dict[int, list] = {}
    for r in some:
        by_size.setdefault(len(r["vector"]), []).append(r)
    blocks = {size: (np.array([r["node"] for r in rows]), matrix([r["vector"] for r in rows])) for size, rows in by_size.items()}

    def truth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for node, value in zip(batch.column("node").to_pylist(), batch.column("vector").to_pylist(), strict=True):
                if len(value) in blocks:
                    ids, x = blocks[len(value)]
                    near = ids[(x @ matrix([value])[0] >= least) & (ids != node)]
                    a += near.tolist()
                    b += [node] * len(near)
            yield pa.record_batch({"node": pa.array(a, pa.int64()), "other": pa.array(b, pa.int64())})

    links = vectors.mapInArrow(truth, "node long, other long")
    own = lists.select("node", F.transform("near", lambda x: x["other"]).alias("others"), saturated(least).alias("full"))
    theirs = own.select(F.col("node").alias("other"), F.col("others").alias("their_others"), F.col("full").alias("their_full"))
    held = links.join(own, "node", "left").join(theirs, "other", "left")
    found = (F.col("full") & F.col("their_full")) | F.array_contains("others", F.col("other")) | F.array_contains("their_others", F.col("node"))
    n = held.agg(F.count("*").alias("n"), F.count_if(F.coalesce(found, F.lit(False))).alias("found")).collect()[0]
    return n["found"] / n["n"] if n["n"] else 1.0


def _count(least: float):
    """Links of the vectors of one pair of blocks, counted by multiplicity; no pair is written."""

    def count(table: pa.Table) -> pa.Table:
        nodes, weight, side = (table.column(c).to_numpy() for c in ("node", "n", "side"))
        x = matrix(table.column("vector").to_pylist())
        left, right = np.flatnonzero(side < 2), np.flatnonzero(side > 0)
        near = (x[left] @ x[right].T >= least) & (nodes[left][:, None] != nodes[right][None, :])
        out = [(nodes[left], near @ weight[right])]
        if not (side == 1).any():
            out.append((nodes[right], near.T @ weight[left]))
        return pa.table({"node": np.concatenate([o[0] for o in out]), "links": np.concatenate([o[1] for o in out]).astype(np.int64)})

    return count


def block_counts(members: DataFrame, least: float) -> DataFrame:
    """Exact number of links inside each component, block against block (``node, label, n, vector``)."""
    sizes = members.groupBy("label").agg(F.count("*").alias("size"))
    rows = members.join(sizes, "label").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.sequence(F.lit(0), F.col("blocks") - 1)
    rows = rows.select("label", "node", "n", "vector", "block", F.explode(other).alias("other"))
    side = F.when(F.col("block") == F.col("other"), 1).when(F.col("block") < F.col("other"), 0).otherwise(2)
    rows = rows.select("label", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "n", "vector", side.alias("side"))
    return rows.groupBy("label", "i", "j").applyInArrow(_count(least), "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def _reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Angle of every vector with the center of its component."""
    for batch in batches:
        pairs = zip(batch.column("vector").to_pylist(), batch.column("center").to_pylist(), strict=True)
        cosines = [float((matrix([v]) @ matrix([c]).T)[0, 0]) for v, c in pairs]
        yield pa.record_batch({"label": batch.column("label"), "angle": pa.array(np.arccos(np.clip(cosines, -1, 1)), pa.float64())})


def _close(least: float):
    """Pairs of components of two blocks of centers that can hold a link, by their radii."""

    def close(table: pa.Table) -> pa.Table:
        labels, radius, side = (table.column(c).to_numpy() for c in ("label", "radius", "side"))
        vectors = table.column("center").to_pylist()
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        right = np.flatnonzero(side > 0)
        other = matrix([vectors[i] for i in right]) if len(right) else None
        for rows in np.split(left := np.flatnonzero(side < 2), range(BLOCK, len(left), BLOCK)) if len(right) else ():
            if len(rows):
                angle = np.arccos(np.clip(matrix([vectors[i] for i in rows]) @ other.T, -1, 1))
                i, j = np.nonzero(angle <= radius[rows][:, None] + radius[right][None, :] + np.arccos(least) + SLACK)
                i, j = labels[rows[i]], labels[right[j]]
                a.append(np.minimum(i, j)[i != j])
                b.append(np.maximum(i, j)[i != j])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return close


def _count_across(least: float):
    """Links between the vectors of a block of one component and a block of another, by multiplicity."""

    def count(table: pa.Table) -> pa.Table:
        nodes, weight, first = (table.column(c).to_numpy(zero_copy_only=False) for c in ("node", "n", "first"))
        x = matrix(table.column("vector").to_pylist())
        left, right = np.flatnonzero(first), np.flatnonzero(~first)
        near = x[left] @ x[right].T >= least
        links = np.zeros(len(nodes), np.int64)
        links[left], links[right] = near @ weight[right], near.T @ weight[left]
        some = np.flatnonzero(links)
        return pa.table({"a": table.column("a").take(some), "b": table.column("b").take(some), "node": nodes[some], "links": links[some]})

    return count


def across(members: DataFrame, least: float) -> DataFrame:
    """Exact number of links between components (``a, b, node, links``).

    A component's center is one of its vectors and its radius the largest angle with it, so two
    components whose centers are further apart than their radii and the angle of a link have none.
    Centers meet block against block, and then the blocks of the components that are left.
    """
    sizes = members.groupBy("label").agg(F.count("*").alias("size"))
    centers = members.where(F.col("node") == F.col("label")).select("label", F.col("vector").alias("center"))
    reach = members.join(centers, "label").select("label", "vector", "center").mapInArrow(_reach, "label long, angle double")
    centers = written(centers.join(reach.groupBy("label").agg(F.max("angle").alias("radius")), "label").join(sizes, "label"), "centers")
    n = max(CENTER_PARTS, ceil(centers.count() / CENTERS))
    parts = centers.select("label", "center", "radius", F.length("center").alias("width"), F.pmod(F.xxhash64("label"), F.lit(n)).cast("int").alias("part"))
    parts = parts.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    side = F.when(F.col("part") == F.col("other"), 1).when(F.col("part") < F.col("other"), 0).otherwise(2)
    parts = parts.select("width", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "label", "center", "radius", side.alias("side"))
    close = written(parts.groupBy("width", "i", "j").applyInArrow(_close(least), "a long, b long").distinct(), "close")
    count = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    close = close.join(sizes.select(F.col("label").alias("a"), count("size").alias("a_blocks")), "a").join(sizes.select(F.col("label").alias("b"), count("size").alias("b_blocks")), "b")
    rows = []
    for own, other in (("a", "b"), ("b", "a")):
        block = F.pmod(F.xxhash64("node"), F.col(f"{own}_blocks")).cast("int")
        met = close.join(members.withColumnRenamed("label", own), own)
        met = met.select("a", "b", block.alias(f"{own}_block"), F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1)).alias(f"{other}_block"), "node", "n", "vector")
        rows.append(met.select("a", "b", "a_block", "b_block", "node", "n", "vector", F.lit(own == "a").alias("first")))
    return rows[0].union(rows[1]).groupBy("a", "b", "a_block", "b_block").applyInArrow(_count_across(least), "a long, b long, node long, links long")


def link_embeddings(embeddings: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", least: float = 0.95) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, one row per row of ``embeddings``.

    Equal vectors are one node. Leaves of random-hyperplane trees give first neighbour lists, and
    rounds of comparing neighbours of neighbours improve them. An audit against brute force on a
    fixed number of vectors adds rounds, with lists twice as long, until it finds its links. Pairs
    of cosine ``least`` or more, in double precision, are links. A list that is full of links is
    saturated: there the whole component is counted, block against block, so that dense groups
    lose no link and write no pairs. A link that neither list has room for joins two such components,
    so these are also counted against each other, where their radii allow a link, and joined. If the audit has not passed after ``ROUNDS`` rounds,
    every component and every single vector is counted like this, so the result is exact.

    Null, empty and zero vectors and those with a null or non-finite component link with nothing, and
    vectors of another length link only with their like. A null id takes part; ids that repeat count
    as further vectors. A component's id is the smallest of its ids. An empty table gives no rows.
    Ties in a list are ordered by node. Other columns are ignored.
    """
    rows = embeddings.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("embedding"))
    packed = written(rows.mapInArrow(_valid("embedding"), "vec_id long, vector binary"), "vectors")
    nodes = packed.where(F.col("vector").isNotNull()).groupBy("vector").agg(F.count("*").alias("n"), F.min("vec_id").alias("smallest"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    vectors = nodes.select("node", "vector")
    total = nodes.count()
    bits = max(1, ceil(log2(max(total, 2) / LEAF)))
    leaves = vectors.mapInArrow(_codes(bits), "node long, codes array<long>").select("node", F.explode("codes").alias("code"))
    first = salted(leaves, "code", 2 * LEAF).select("group", "node").join(vectors, "node").withColumn("floor", F.lit(-2.0))
    k, passed = NEIGHBOURS, False
    lists = written(shortened(bucketed(first.select("group", "node", "floor", "vector"), k), k), "lists")
    for turn in range(ROUNDS):
        lists = descend(lists, vectors, k)
        passed = turn > 0 and audit(lists, vectors, least) >= RECALL
        if passed:
            break
        if turn:
            k *= 2
    near = lists.select("node", F.explode("near").alias("near")).where(F.col("near.sim") >= least).select("node", F.col("near.other").alias("other"))
    near = written(near.union(near.select("other", "node")).distinct(), "links")
    labels = smallest_labels(near, "node", "other")
    if not passed:
        labels = vectors.select("node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    full = (lists.where(saturated(least)) if passed else vectors).select("node").join(labels, "node").select("label").distinct()
    labels = written(labels.join(full.withColumn("full", F.lit(True)), "label", "left"), "labels")
    members = written(labels.where("full").join(nodes, "node").select("label", "node", "n", "vector"), "members")
    crossing = written(across(members, least), "across")
    counted = block_counts(members, least).union(crossing.select("node", "links"))
    loose = labels.where("full is null").select("node").join(near, "node").join(nodes.select(F.col("node").alias("other"), "n"), "other").select("node", F.col("n").alias("links"))
    counted = counted.union(loose).groupBy("node").agg(F.sum("links").alias("links"))
    joined = smallest_labels(crossing.select("a", "b").distinct(), "a", "b").select(F.col("node").alias("label"), F.col("label").alias("top"))
    labels = labels.join(joined, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    own = nodes.select("node", "vector", "n", "smallest").join(labels.select("node", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    own = own.join(own.groupBy("label").agg(F.min("smallest").alias("component_id")), "label").join(counted, "node", "left")
    own = own.select("vector", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = packed.join(own, "vector", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
