"""MinHash near-deduplication by a multi-index Hamming join."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnscope.llm.common import chunks, gram_hashes, mix, sliced, smallest_labels, word_hashes, written

SHINGLE = 5
# Signatures have values of 8 bits, in chunks of 6 values. Signatures that agree in a chunk but for one
# value at most share a key, since there is one for every chunk and every value left out of it. 8 chunks
# are enough at similarity 0.85: 6 in a million pairs just there agree in no chunk.
WIDTH = 6
CHUNKS, CHUNKS_AT = 8, 85
STAR_ROUNDS = 3
# Words of 64 bits in a parity sketch.
SKETCH = 16


def chunk_miss(percent: int) -> float:
    """Probability that two signatures of texts of this similarity differ in two values of a chunk or more."""
    same = percent / 100
    return 1 - same**WIDTH - WIDTH * (1 - same) * same ** (WIDTH - 1)


def chunks_for(percent: int) -> int:
    """Chunks with which a pair just at ``percent`` % is missed no more often than with ``CHUNKS`` at ``CHUNKS_AT``."""
    if percent >= CHUNKS_AT:
        return CHUNKS
    return ceil(CHUNKS * log(chunk_miss(CHUNKS_AT)) / log(chunk_miss(percent)))


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of every text's 5-word shingles; fewer words are one shingle."""
    out: list[np.ndarray] = []
    for at, end in chunks(texts):
        words, bounds = word_hashes(texts[at:end])
        grams = gram_hashes(words, SHINGLE)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= SHINGLE:
                out.append(np.unique(grams[a : b - SHINGLE + 1]))
            else:
                out.append(gram_hashes(words[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], n_values: int) -> np.ndarray:
    """One row of ``n_values`` bytes for every set; empty sets get zeros."""
    sizes = np.array([len(s) for s in sets])
    out = np.zeros((len(sets), n_values), np.uint8)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    seeds = np.random.default_rng(85).integers(0, 1 << 64, (n_values, 2), dtype=np.uint64) | np.uint64(1)
    values, starts = np.concatenate([sets[i] for i in full]), np.cumsum(sizes[full]) - sizes[full]
    for k, (a, b) in enumerate(seeds):
        out[full, k] = mix(np.minimum.reduceat(values * a + b, starts)) >> np.uint64(56)
    return out


def marks(sets: list[np.ndarray]) -> list[bytes]:
    """128-bit mark of every set: equal sets have equal marks."""
    return [np.array([mix(s ^ np.uint64(11)).sum(), mix(s ^ np.uint64(12)).sum()], np.uint64).tobytes() for s in sets]


def text_bytes(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _sign(n_values: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = [t.translate(_LOWER) for t in text_bytes(batch.column("text"))]
            for at, end in chunks(texts, 1 << 22):
                sets = shingle_sets(texts[at:end])
                yield pa.record_batch({
                    "doc_id": batch.column("doc_id").slice(at, end - at),
                    "text_hash": batch.column("text_hash").slice(at, end - at),
                    "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "mark": pa.array(marks(sets), pa.binary()),
                    "signature": pa.array([row.tobytes() for row in signatures(sets, n_values)], pa.binary()),
                })

    return sign


_LOWER = bytes(range(256)).lower()


def _keys(n_chunks: int):
    """A key for each value of a signature: its chunk, its place left out, and the chunk's other five values."""
    others = [[p for p in range(WIDTH) if p != j] for j in range(WIDTH)]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint8).reshape(-1, n_chunks, WIDTH).astype(np.int64)
            keys = np.empty((len(rows), n_chunks, WIDTH), np.int64)
            for j, rest in enumerate(others):
                key = np.arange(n_chunks)[None, :] * WIDTH + j
                for p in rest:
                    key = key << 8 | rows[:, :, p]
                keys[:, :, j] = key
            nodes = batch.column("node").to_numpy(zero_copy_only=False)
            yield pa.record_batch({"key": pa.array(keys.ravel()), "node": pa.array(np.repeat(nodes, n_chunks * WIDTH))})

    return keyed


def _own_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingle sets of nodes, from texts whose set is that of the node; an id can occur with several."""
    for batch in sliced(batches):
        texts = [t.translate(_LOWER) for t in text_bytes(batch.column("text"))]
        for at, end in chunks(texts, 1 << 22):
            sets = shingle_sets(texts[at:end])
            own = [m == w for m, w in zip(marks(sets), batch.column("mark").slice(at, end - at).to_pylist(), strict=True)]
            yield pa.record_batch({"node": batch.column("node").slice(at, end - at), "shingles": pa.array([s.tobytes() for s in sets], pa.binary())}).filter(pa.array(own, pa.bool_()))


def _confirm(percent: int):
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (a, b))
                both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.record_batch({"a": batch.column("a"), "b": batch.column("b")}).filter(pa.array(keep, pa.bool_()))

    return links


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full shingle sets are similar enough."""
    rows = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")), "a")
    rows = rows.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b")), "b")
    return rows.select("a", "b", "set_a", "set_b").mapInArrow(_confirm(percent), "a long, b long")


def star_pairs(open_keys: DataFrame, turn: int, percent: int) -> DataFrame:
    """Every node of a key with the key's center, where their labels differ. The first center is the
    node with the smallest part of shingles of its own, later ones are chosen by a hash."""
    rank = F.when(F.lit(turn > 0), F.lit(0)).otherwise(F.floor(1000 * F.col("alone") / F.col("n")))
    center = F.struct(rank.alias("rank"), F.xxhash64("node", F.lit(turn)), F.col("node"), F.col("label"), F.col("n"), F.col("alone"), F.col("sketch"))
    rows = open_keys.alias("own").join(open_keys.groupBy("key").agg(F.min(center).alias("center")), "key")
    rows = rows.where((F.col("own.label") != F.col("center.label")) & can_link("own", "center", percent))
    return rows.select(F.least("node", "center.node").alias("a"), F.greatest("node", "center.node").alias("b")).distinct()


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = batch.column("shingles").to_pylist()
        nodes = np.repeat(batch.column("node").to_numpy(), [len(s) // 8 for s in sets])
        yield pa.record_batch({"node": pa.array(nodes), "shingle": pa.array(np.frombuffer(b"".join(sets), np.int64))})


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parity sketches: a bit tells whether an odd number of a set's shingles fall on it. The exclusive or of
    two is the sketch of what only one of both sets has, so its bits are at most as many as that."""
    for batch in batches:
        out = np.zeros((batch.num_rows, SKETCH * 64), np.uint8)
        for row, data in zip(out, batch.column("shingles"), strict=True):
            places = mix(np.frombuffer(data.as_buffer(), np.uint64) ^ np.uint64(13)) % np.uint64(SKETCH * 64)
            row[:] = np.bincount(places.astype(np.int64), minlength=SKETCH * 64) & 1
        words = np.packbits(out, axis=1).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, words.size + 1, SKETCH), pa.int32()), pa.array(words.ravel()))
        yield pa.record_batch({"node": batch.column("node"), "sketch": lists})


def with_own_shingles(shared: DataFrame, sets: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Keys with the number of shingles of each node and of those that no other node with keys has, and
    with its parity sketch.

    Shingles of one node are in no intersection, so a node with too many of them can link with nothing.
    """
    single = sets.mapInArrow(_shingles, "node long, shingle long").groupBy("shingle").agg(F.count("*").alias("n"), F.min("node").alias("node"))
    alone = single.where("n = 1").groupBy("node").agg(F.count("*").alias("alone"))
    sizes = sets.select("node").join(nodes.select("node", F.col("n_shingles").alias("n")), "node").join(alone, "node", "left")
    sizes = sizes.withColumn("alone", F.coalesce("alone", F.lit(0))).where(100 * (F.col("n") - F.col("alone")) >= percent * F.col("n"))
    sizes = sizes.join(sets.mapInArrow(_sketches, "node long, sketch array<long>"), "node")
    return shared.join(sizes, "node").select("key", "node", "n", "alone", "sketch")


def can_link(a: str, b: str, percent: int) -> Column:
    """Whether two nodes can be similar enough: if they share all shingles but those of their own, and if no
    more shingles are in one of both alone than bits of their sketches differ. Neither loses a link."""
    both = F.least(F.col(f"{a}.n") - F.col(f"{a}.alone"), F.col(f"{b}.n") - F.col(f"{b}.alone"))
    total = F.col(f"{a}.n") + F.col(f"{b}.n")
    differ = sum((F.bit_count(F.get(f"{a}.sketch", F.lit(i)).bitwiseXOR(F.get(f"{b}.sketch", F.lit(i)))) for i in range(SKETCH)), F.lit(0))
    return (100 * both >= percent * (total - both)) & ((100 + percent) * differ <= (100 - percent) * total)


def all_pairs(open_keys: DataFrame, percent: int) -> DataFrame:
    """Pairs of one key whose nodes are not known to be connected and can be similar enough, each at the
    first of the keys that they share."""
    own = open_keys.groupBy("node").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    open_keys = written(open_keys.join(own, "node"), "own")
    x, y = open_keys.alias("x"), open_keys.alias("y")
    new = (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.label") != F.col("y.label"))
    first = F.array_min(F.array_intersect("x.keys", "y.keys")) == F.col("x.key")
    return x.join(y, new & can_link("x", "y", percent) & first).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def near_duplicates(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """``doc_id, text_hash, n_shingles, component_id, kept``, one row per row of ``documents``; ``text_hash``
    is ``xxhash64`` of the text and tells the rows of a repeated id apart.

    Documents are linked if their 5-word shingle sets have a similarity of at least ``percent`` %.
    Equal sets are one node. Nodes that share a key are compared with the key's center first; nodes
    that this connects need no further comparison, since links reach through the center. What is left
    of a key, nodes not known to be connected, is compared in full, but for pairs that the shingles of
    one node alone or their parity sketches rule out, so no link is lost to a hot key.

    Null or empty texts have no shingles and no links. A null id has no component; its row is kept.
    An id that occurs with several texts takes part with each, and each of its rows has the component
    of its text. Repeated rows get the same values and stay. Very long texts are shingled whole; an
    empty table gives no rows; other columns are ignored.
    """
    n_chunks = chunks_for(percent)
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    signed = written(docs.mapInArrow(_sign(n_chunks * WIDTH), "doc_id long, text_hash long, n_shingles long, mark binary, signature binary"), "signatures")
    nodes = signed.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).groupBy("mark").agg(F.min("doc_id").alias("doc_id"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    keys = nodes.select("node", "signature").mapInArrow(_keys(n_chunks), "key long, node long")
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    shared = written(keys.join(shared, "key"), "keys")
    wanted = shared.select("node").distinct().join(nodes, "node").select("doc_id", "mark", "node")
    sets = docs.join(wanted, "doc_id").select("node", "mark", "text").mapInArrow(_own_sets, "node long, shingles binary")
    sets = written(sets.dropDuplicates(["node"]), "sets")
    shared = written(with_own_shingles(shared, sets, nodes, percent), "able")
    labels, links, tested, idle = None, None, None, False
    for turn in count():
        if labels is None:
            labelled = shared.withColumn("label", F.col("node"))
        else:
            labelled = shared.join(labels, "node", "left").select("key", "node", "n", "alone", "sketch", F.coalesce("label", "node").alias("label"))
            unsettled = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
            labelled = written(labelled.join(unsettled, "key"), "open")
        last = turn >= STAR_ROUNDS or idle
        pairs = all_pairs(labelled, percent) if last else star_pairs(labelled, turn, percent)
        pairs = written(pairs.join(tested, ["a", "b"], "left_anti") if tested is not None else pairs, "pairs")
        found = written(confirmed(pairs, sets, percent), "links")
        tested, links = (pairs, found) if tested is None else (tested.union(pairs), links.union(found))
        idle = labels is not None and not found.limit(1).count()
        if not idle:
            labels = smallest_labels(links, "a", "b")
        if last:
            break
    ids = nodes.select("node", "mark", "doc_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    component = ids.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    members = ids.join(component, "label").select("mark", "component_id")
    rows = signed.select("doc_id", "text_hash", "n_shingles", "mark").join(members, "mark", "left")
    rows = rows.withColumn("component_id", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")))
    return rows.select(
        "doc_id", "text_hash", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )
