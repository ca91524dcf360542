"""Substring deduplication by grouping the hashes of 13-word windows, in ranges of a hash of their first words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnscope.llm.common import _PLACES, chunks, gram_hashes, mix, positions_left, word_hashes, written
from tarnscope.llm.near_dedup import text_bytes

WINDOW = 13
GRAM = 5
# A suffix is cut after 13 words and written as two symbols: a 64-bit code of its first six words,
# and one of the other seven.
FIRST = 6
# Suffixes that one subtree may hold (about 100 bytes each while it is built).
GROUP = 2_000_000
# An anchor in this share of a batch's texts, and in so many, has its windows partitioned by their whole length.
HOT_SHARE, HOT_TEXTS = 0.02, 100


def anchors(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest 5-gram hash of the 13-word window at each position, and whether a window starts there."""
    left = positions_left(bounds)
    grams = gram_hashes(words, GRAM)
    n = len(words) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    low = grams[:n].copy()
    for j in range(1, WINDOW - GRAM + 1):
        np.minimum(low, grams[j : n + j], out=low)
    return low, left[:n] >= WINDOW


def packed(parts: np.ndarray, order: np.ndarray, **arrays: np.ndarray) -> Iterator[tuple[int, dict[str, bytes]]]:
    """The rows of each part as bytes. ``order`` sorts by part."""
    sorted_parts = parts[order]
    cuts = np.flatnonzero(np.diff(sorted_parts)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(order)], strict=True):
        if b > a:
            yield int(sorted_parts[a]), {name: values[order[a:b]].tobytes() for name, values in arrays.items()}


def per_text(ids: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(ids, kind="stable")
    cuts = np.flatnonzero(np.diff(ids[order])) + 1
    for rows in np.split(order, cuts):
        if len(rows):
            yield int(ids[rows[0]]), hashes[rows].tobytes()


def _census(n_parts: int):
    """Anchors of every batch: those of one text go to a part by hash, those of several are known to
    repeat and are noted at once; of these the part gets one entry. So no anchor, however common,
    sends more than one entry a batch."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = text_bytes(batch.column("text")), batch.column("doc_id").to_numpy()
            found, owner = [], []
            for at, end in chunks(texts):
                words, bounds = word_hashes(texts[at:end])
                low, starts = anchors(words, bounds)
                fresh = starts.copy()
                fresh[1:] &= (low[1:] != low[:-1]) | ~starts[:-1]
                where = np.flatnonzero(fresh)
                found.append(low[where])
                owner.append(np.searchsorted(bounds, where, side="right") - 1 + at)
            found, owner = np.concatenate(found), np.concatenate(owner)
            order = np.lexsort((owner, found))
            found, owner = found[order], owner[order]
            keep = np.append(True, (found[1:] != found[:-1]) | (owner[1:] != owner[:-1]))[: len(found)]
            found, owner = found[keep], owner[keep]
            first = np.append(True, found[1:] != found[:-1])[: len(found)]
            size = np.diff(np.append(np.flatnonzero(first), len(found)))
            many = np.repeat(size > 1, size)
            known = found[first & many]
            hot = known[size[size > 1] > max(HOT_TEXTS, HOT_SHARE * len(texts))]
            rows = []
            for kind, values, docs in ((0, found[~many], ids[owner[~many]]), (2, known, np.zeros(len(known), np.int64))):
                part = (values % np.uint64(n_parts)).astype(np.int64)
                rows += [(p, kind, x["docs"], x["values"]) for p, x in packed(part, np.lexsort((docs, part)), docs=docs, values=values)]
            for doc, values in per_text(ids[owner[many]], found[many]):
                rows.append((doc % n_parts, 1, np.int64(doc).tobytes(), values))
            if len(hot):
                rows.append((0, 3, b"", hot.tobytes()))
            yield pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["part", "kind", "docs", "hashes"])

    return count


def _repeated(table: pa.Table) -> pa.Table:
    """Of one part: anchors that several batches hold, per text, and what was noted before."""
    kinds = np.array(table.column("kind").to_pylist())
    docs, hashes = table.column("docs").to_pylist(), table.column("hashes").to_pylist()
    join = lambda data, kind, dtype: np.frombuffer(b"".join(d for d, k in zip(data, kinds, strict=True) if k == kind), dtype)
    single, owner, known = join(hashes, 0, np.uint64), join(docs, 0, np.int64), join(hashes, 2, np.uint64)
    values, where, n = np.unique(np.concatenate([single, known]), return_inverse=True, return_counts=True)
    again = n[where[: len(single)]] > 1
    out = [(1, doc, got) for doc, got in per_text(owner[again], single[again])]
    out += [(int(k), int.from_bytes(d, "little", signed=True), h) for k, d, h in zip(kinds, docs, hashes, strict=True) if k in (1, 3)]
    return pa.table([pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int32(), pa.int64(), pa.binary()))], ["kind", "doc_id", "hashes"])


def _suffixes(hot_anchors: np.ndarray, n_groups: int, hot: bool):
    """Suffixes at the windows whose anchor repeats, by group: a range of the first symbol's codes."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids, keys = text_bytes(batch.column("text")), batch.column("doc_id").to_numpy(), batch.column("row_key").to_numpy()
            sets, copies = batch.column("sets").to_pylist(), batch.column("copies").to_pylist()
            got = []
            for row, text in enumerate(texts):
                if keys[row] in copies[row] or not sets[row]:
                    continue
                words, bounds = word_hashes([text])
                low, starts = anchors(words, bounds)
                at = np.flatnonzero(starts & np.isin(low, np.frombuffer(b"".join(sets[row]), np.uint64)))
                at = at[np.isin(low[at], hot_anchors) == hot]
                got.append((gram_hashes(words, FIRST)[at], gram_hashes(words[FIRST:], WINDOW - FIRST)[at], np.full(len(at), row), at.astype(np.int32), low[at]))
            if not got:
                continue
            one, two, row, at, low = (np.concatenate(x) for x in zip(*got, strict=True))
            if hot:
                yield _runs(one, two, low, row, at, ids, keys)
                continue
            group = ((one >> np.uint64(32)) * np.uint64(n_groups) >> np.uint64(32)).astype(np.int64)
            rows = list(packed(group, np.lexsort((row, group)), one=one, two=two, doc=ids[row], key=keys[row], at=at))
            yield pa.record_batch({"part": pa.array([p for p, _ in rows], pa.int32())} | {n: pa.array([x[n] for _, x in rows], pa.binary()) for n in ("one", "two", "doc", "key", "at")})

    return emit


def _runs(one: np.ndarray, two: np.ndarray, low: np.ndarray, row: np.ndarray, at: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
    """Neighbouring windows of one anchor, nine at most, as one row: equal passages give equal runs."""
    fresh = np.append(True, (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1) | (low[1:] != low[:-1]))[: len(at)]
    start = np.flatnonzero(fresh)
    place = np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))
    codes = [np.add.reduceat(mix(x * _PLACES[place]), start).view(np.int64) if len(start) else np.zeros(0, np.int64) for x in (one, two)]
    ends = pa.array(np.append(start, len(at)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(ends, pa.array(x.view(np.int64))) for x in (one, two)]
    names = ["run", "run_two", "one", "two", "doc_id", "row_key", "at"]
    return pa.RecordBatch.from_arrays([*map(pa.array, codes), *lists, pa.array(ids[row[start]]), pa.array(keys[row[start]]), pa.array(at[start])], names)


def _late_in_runs(runs: DataFrame) -> DataFrame:
    """``doc_id, row_key, at`` of windows under very common anchors that a smaller document has.

    Equal runs are aggregated map-side first; their windows are the leaves whose smallest document is
    taken over all kinds of runs, and goes back to the kinds of runs and from there to the documents.
    """
    kind = ["run", "run_two"]
    kinds = runs.groupBy(*kind).agg(F.min("doc_id").alias("smallest"), F.first("one").alias("one"), F.first("two").alias("two"))
    leaves = kinds.select(*kind, "smallest", F.posexplode(F.arrays_zip("one", "two")).alias("i", "leaf"))
    nodes = leaves.groupBy("leaf").agg(F.min("smallest").alias("smallest"))
    found = leaves.drop("smallest").join(nodes, "leaf").groupBy(*kind).agg(F.array_sort(F.collect_list(F.struct("i", "smallest"))).alias("nodes"))
    late = F.filter(F.transform("nodes", lambda x: F.when(x["smallest"] < F.col("doc_id"), F.col("at") + x["i"])), lambda p: p.isNotNull())
    rows = runs.drop("one", "two").join(found, kind).select("doc_id", "row_key", late.alias("late")).where(F.size("late") > 0)
    hexes = F.transform(F.flatten(F.collect_list("late")), little_endian)
    return rows.groupBy("doc_id", "row_key").agg(F.unhex(F.array_join(hexes, "")).alias("at"))


def _subtree(table: pa.Table) -> pa.Table:
    """Suffixes of one group in order are the leaves of its tree; where neighbours agree in all 13 words
    they hang on one deep node. The node's smallest document keeps the window, later ones lose it."""
    kinds = {"one": np.uint64, "two": np.uint64, "doc": np.int64, "key": np.int64, "at": np.int32}
    one, two, doc, key, at = (np.frombuffer(b"".join(table.column(n).to_pylist()), kind) for n, kind in kinds.items())
    order = np.lexsort((doc, two, one))
    one, two, doc, key, at = (x[order] for x in (one, two, doc, key, at))
    start = np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]))[: len(one)]
    smallest = doc[start][np.cumsum(start) - 1]
    late = doc > smallest
    doc, key, at = doc[late], key[late], at[late]
    order = np.lexsort((at, key, doc))
    doc, key, at = doc[order], key[order], at[order]
    cuts = np.flatnonzero((np.diff(doc) != 0) | (np.diff(key) != 0)) + 1
    starts = np.concatenate([[0], cuts])[: len(cuts) + (len(doc) > 0)]
    return pa.table({"doc_id": pa.array(doc[starts]), "row_key": pa.array(key[starts]), "at": pa.array([x.tobytes() for x in np.split(at, cuts)][: len(starts)], pa.binary())})


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, rows = batch.column("row_key").to_pylist(), []
        for text, key, spans in zip(text_bytes(batch.column("text")), keys, batch.column("spans").to_pylist(), strict=True):
            words = text.split()
            n, gone = len(words), None
            own = [s["at"] for s in spans or [] if s["row_key"] == key]
            if any(a is None for a in own):
                kept = [] if n >= WINDOW else words
            elif own:
                gone = np.zeros(n + 1, np.int32)
                at = np.frombuffer(b"".join(own), np.int32)
                np.add.at(gone, at, 1)
                np.add.at(gone, at + WINDOW, -1)
                kept = [w for w, g in zip(words, np.cumsum(gone), strict=False) if not g]
            else:
                kept = words
            rows.append((n, n - len(kept), b" ".join(kept)))
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_words": pa.array([r[0] for r in rows], pa.int64()), "n_removed": pa.array([r[1] for r in rows], pa.int64()), "kept": pa.array([r[2] for r in rows], pa.binary())})


def remove_repeats(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept``, one row per row of ``documents``: words in a 13-word window
    that also starts in a document with a smaller id are removed. ``kept`` is the rest as UTF-8.

    Windows that can repeat are found first: equal windows share their anchor, the smallest hash of
    their 5-word grams, so anchors of one text only are left out. The suffixes at the other windows,
    cut after 13 words, are partitioned by prefix: a range of codes of their first six words, sized
    by their number, and for anchors in very many texts all 13 words. Suffixes of a group, sorted,
    are the leaves of a subtree; its nodes at 13 words are the repeats. Groups of a whole-length
    prefix are aggregated map-side first, run by run of neighbouring windows, so no task holds a common
    passage's leaves. Symbols are 128 bits for 13 words; texts are compared by them.

    Exact copies need no tree: all their windows start in the smallest of them. Null and empty texts
    and those under 13 words lose nothing. Rows without an id neither give nor lose words. Repeated rows
    of one id do not remove each other's words; an id with several texts takes part with each. Very
    long texts are used whole; other columns are ignored; an empty table gives no rows.
    """
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    docs = docs.withColumn("row_key", F.xxhash64("doc_id", "text"))
    named = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    n_parts = max(64, 4 * named.rdd.getNumPartitions())
    census = named.select("doc_id", "text").mapInArrow(_census(n_parts), "part int, kind int, docs binary, hashes binary")
    flags = written(census.groupBy("part").applyInArrow(_repeated, "kind int, doc_id long, hashes binary"), "flags")
    found = flags.groupBy("kind").agg(F.sum(F.length("hashes") / 8).alias("n")).collect()
    total = next((r["n"] for r in found if r["kind"] == 1), 0)
    hot = np.unique(np.frombuffer(b"".join(r["hashes"] for r in flags.where("kind = 3").collect()), np.uint64))
    n_groups = max(16, int(total * (WINDOW - GRAM + 1)) // GROUP)
    same = named.select("doc_id", "row_key", F.md5("text").alias("mark"))
    smallest = same.groupBy("mark").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    copies = written(same.join(smallest, "mark").where("doc_id > first").select("doc_id", "row_key").distinct(), "copies")
    notes = flags.where("kind = 1").select("doc_id", "hashes", F.lit(None).cast("long").alias("row_key")).unionByName(copies, allowMissingColumns=True)
    notes = notes.groupBy("doc_id").agg(F.collect_list("hashes").alias("sets"), F.collect_list("row_key").alias("copies")).where(F.size("sets") > 0)
    rows = named.join(notes, "doc_id")
    packs = rows.mapInArrow(_suffixes(hot, n_groups, False), "part int, one binary, two binary, doc binary, key binary, at binary")
    spans = packs.groupBy("part").applyInArrow(_subtree, "doc_id long, row_key long, at binary")
    if len(hot):
        runs = rows.mapInArrow(_suffixes(hot, n_groups, True), "run long, run_two long, one array<long>, two array<long>, doc_id long, row_key long, at int")
        spans = spans.union(_late_in_runs(written(runs, "runs")))
    spans = spans.unionByName(copies, allowMissingColumns=True)
    spans = spans.groupBy("doc_id").agg(F.collect_list(F.struct("row_key", "at")).alias("spans"))
    return docs.join(spans, "doc_id", "left").select("doc_id", "row_key", "text", "spans").mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept binary")


def little_endian(x):
    """Eight hexadecimal digits of a 32-bit number, lowest byte first."""
    digits = F.lpad(F.hex(x), 8, "0")
    return F.concat(*[F.substring(digits, i, 2) for i in (7, 5, 3, 1)])
