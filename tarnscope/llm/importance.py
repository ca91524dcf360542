"""Resampling of documents towards a target distribution by importance weights of hashed n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnscope.llm.common import sliced, small_batches, written

BUCKETS = 10_000
# A word is a run of digits, letters a-z and bytes beyond ASCII; all else becomes a blank.
LETTERS = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in bytes(range(256)).lower())
# The order of documents, best first. All parts are integers, so that a key is four of them; ``row``
# tells equal rows apart.
KEY = ("low", "id", "text_hash", "row")
LAST = np.iinfo(np.int64).max


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(LETTERS).split()


def features_of(words: list[bytes]) -> np.ndarray:
    """Buckets of all words and of all pairs of neighbours, repeats included. The checksum of a pair
    goes on from that of its first word and a blank."""
    single = list(map(crc32, words))
    pairs = [crc32(b, crc32(b" ", a)) for a, b in zip(single, words[1:], strict=False)]
    return np.array(single + pairs, np.int64) % BUCKETS


def bucket_counts(texts: DataFrame, text: str) -> np.ndarray:
    """Features of all texts in every bucket. Tasks add up their own first, so 10,000 rows a task at most
    are shuffled, and as many reach the driver in all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in sliced(batches, 200):
            found = [features_of(words_of(value)) for value in batch.column(0).cast(pa.binary()).to_pylist()]
            total += np.bincount(np.concatenate(found), minlength=BUCKETS)
        full = np.flatnonzero(total)
        yield pa.record_batch({"bucket": pa.array(full), "n": pa.array(total[full])})

    rows = texts.select(text).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log-ratio of both smoothed distributions in every bucket, rounded down."""
    s, t = source.astype(np.float64), target.astype(np.float64)
    ratio = (t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def gumbel(doc_id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel variate that depends on seed and id alone, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(-1000 * F.log(-F.log(share)))


def scored_documents(documents: DataFrame, gains: np.ndarray, doc_id: str, text: str, seed: int) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` and the parts of the key, one row per document."""
    shared = documents.sparkSession.sparkContext.broadcast(gains)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in sliced(batches, 200):
            words, weight = [], []
            for value in batch.column("text").cast(pa.binary()).to_pylist():
                said = words_of(value)
                words.append(len(said))
                weight.append(int(table[features_of(said)].sum()) // (2 * len(said) - 1) if said else 0)
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "noise": batch.column("noise"),
                "n_words": pa.array(words, pa.int64()), "weight": pa.array(weight, pa.int64()),
            })

    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), gumbel(F.col(doc_id), seed).alias("noise"), F.col(text).alias("text"))
    rows = rows.mapInArrow(score, "doc_id long, text_hash long, noise long, n_words long, weight long")
    total = F.col("weight") + F.col("noise")
    return rows.select(
        "doc_id", "n_words", F.greatest(2 * F.col("n_words") - 1, F.lit(0)).cast("long").alias("n_features"), "weight", total.alias("score"),
        (-total).alias("low"), F.coalesce("doc_id", F.lit(int(LAST))).alias("id"), "text_hash", F.monotonically_increasing_id().alias("row"),
    )


def below(key: tuple[int, ...], ends: bool = False) -> Column:
    """Whether a row's key is smaller than ``key``, or ``ends`` there."""
    found = F.lit(ends)
    for name, value in zip(reversed(KEY), reversed(key), strict=True):
        found = (F.col(name) < F.lit(value)) | ((F.col(name) == F.lit(value)) & found)
    return found


def _medians(pivot: tuple[int, ...] | None):
    """One row per partition and side, keys up to the pivot and those beyond it: their number and median."""

    def medians(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = [np.stack([b.column(name).to_numpy() for name in KEY]) for b in batches if b.num_rows]
        if not read:
            return
        keys = np.concatenate(read, axis=1)
        keys = keys[:, np.lexsort(keys[::-1])]
        cut = keys.shape[1]
        if pivot is not None:
            within = np.ones(cut, bool)
            for part, value in zip(keys[::-1], pivot[::-1], strict=True):
                within = (part < value) | ((part == value) & within)
            cut = int(within.sum())
        sides = [(side, at, end) for side, at, end in ((0, 0, cut), (1, cut, keys.shape[1])) if end > at]
        middle = keys[:, [(at + end - 1) // 2 for _, at, end in sides]]
        yield pa.record_batch({
            "side": pa.array([side for side, *_ in sides], pa.int32()), "n": pa.array([end - at for _, at, end in sides], pa.int64()),
            **{name: pa.array(part) for name, part in zip(KEY, middle, strict=True)},
        })

    return medians


def weighted_median(medians: list[tuple[tuple[int, ...], int]]) -> tuple[int, ...]:
    """The key at which half of the weight is reached."""
    total, seen = sum(n for _, n in medians), 0
    for key, n in sorted(medians):
        seen += n
        if 2 * seen >= total:
            return key
    raise ValueError("no medians")


def cutoff_key(keys: DataFrame, k: int) -> tuple[int, ...]:
    """The ``k``-th smallest key (from 1), all keys being distinct.

    Every partition gives the median of its remaining keys and their number; the weighted median of these
    splits the keys. About a quarter of them at least lies on each side and is discarded if the cutoff is on
    the other one, whatever the order of the rows. One job a round counts the sides of the last pivot and
    finds both their medians. The driver holds two rows a partition. Keys that remain are written
    anew whenever they have become half, so all rounds together read a small multiple of the keys once.
    """
    rest, in_store = keys, None
    pivot: tuple[int, ...] | None = None
    while True:
        sides: tuple[list, list] = ([], [])
        for r in rest.mapInArrow(_medians(pivot), "side int, n long, low long, id long, text_hash long, row long").collect():
            sides[r["side"]].append((tuple(r[name] for name in KEY), r["n"]))
        within = sum(n for _, n in sides[0])
        if pivot is None:
            left, size = sides[0], within
        elif k == within:
            return pivot
        elif k < within:
            left, size, rest = sides[0], within, rest.where(below(pivot, ends=True))
        else:
            left, size, rest = sides[1], sum(n for _, n in sides[1]), rest.where(~below(pivot, ends=True))
            k -= within
        if size == 1:
            return left[0][0]
        in_store = in_store or size
        if 2 * size <= in_store:
            rest, in_store = written(rest, "keys"), size
        pivot = weighted_median(left)


def resample(documents: DataFrame, target: DataFrame, *, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank``, one row per row of ``documents``: a draw
    without replacement of ``percent`` % of the documents with at least ``least_words`` words, towards the
    texts of ``target``.

    The weight of a document is the mean log-ratio of both distributions over its hashed words and word
    pairs; with a Gumbel variate of its id added, the highest scores are the draw (Gumbel top-k). The
    exact cutoff is found by ``cutoff_key``; only the winners are sorted, by ranges, and ranked from 1.

    Null and empty texts have no features, a weight of 0, and are never drawn. Equal scores go to the
    smaller id, a null id last (its variate is that of an empty id); rows of one id are ordered by a hash of
    their texts, equal rows take neighbouring ranks. Very long texts are read whole. An empty table
    gives no rows; an empty target makes every document as good as its rarest features. Other columns are
    ignored.
    """
    small_batches(documents.sparkSession)
    gains = gains_of(bucket_counts(documents, text), bucket_counts(target, target_text))
    scored = written(scored_documents(documents, gains, doc_id, text, seed), "scored")
    able = scored.where(F.col("n_words") >= least_words)
    k = percent * able.count() // 100
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    if not k:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    drawn = (F.col("n_words") >= least_words) & below(cutoff_key(able.select(*KEY), k), ends=True)
    # Within one range of the sorted winners, neighbouring rows have neighbouring numbers.
    place = F.monotonically_increasing_id()
    winners = written(scored.where(drawn).orderBy(*KEY).select(*columns, place.alias("place")), "winners")
    part = F.shiftrightunsigned("place", 33)
    sizes = sorted((r["part"], r["n"]) for r in winners.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    starts, before = [], 0
    for number, n in sizes:
        starts.append((number, before))
        before += n
    offsets = documents.sparkSession.createDataFrame(starts, "part long, before long")
    ranked = winners.withColumn("part", part).join(F.broadcast(offsets), "part")
    ranked = ranked.select(*columns, (F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("rank"))
    return ranked.unionByName(scored.where(~drawn).select(*columns, F.lit(None).cast("long").alias("rank")))
