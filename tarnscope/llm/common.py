"""Word hashing on Arrow batches and small DataFrame helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnscope.session import scratch_path

CHUNK_BYTES = 1 << 20
# Arrow batches between the JVM and Python end at so many bytes, whatever the length of the texts.
BATCH_BYTES = 4 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACES = _RNG.integers(0, 1 << 64, 64, dtype=np.uint64) | np.uint64(1)
_POWERS = np.ones(1, np.uint64)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of the session's Arrow batches; rows alone say nothing about memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def free_name(name: str, taken: list[str]) -> str:
    """``name``, lengthened until no column in ``taken`` has it."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def packed(df: DataFrame, text: str, pack: str) -> DataFrame:
    """``text`` and one struct ``pack`` of all other columns: no name can clash, and a text travels once."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != text]).alias(pack), F.col(text))


def unpacked(columns: list[str], text: str, pack: str) -> list[Column]:
    """The columns as they were before ``packed``."""
    return [F.col(c) if c == text else F.col(f"{pack}.`{c}`").alias(c) for c in columns]


def written(df: DataFrame, name: str, once: bool = False) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: its rows are computed once, and a
    lost executor costs no recomputation of what stands above. With ``once`` the files of its shuffles
    are removed when it is written, as nothing else will read them."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    if once:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if once:
            spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the table of ``written`` that ``df`` reads, once nothing will read it again."""
    jvm = df.sparkSession._jvm
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        if path.getName().startswith("tarnscope-"):
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def with_fields(df: DataFrame, **kinds: T.DataType) -> T.StructType:
    """The schema of ``df`` and further columns."""
    return T.StructType([*df.schema.fields, *(T.StructField(name, kind) for name, kind in kinds.items())])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where lambda functions in ``body`` use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def bucket_of_id(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.when(doc_id.isNotNull(), F.crc32(doc_id.cast("string").cast("binary")) % modulus)


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finalizer, so that any bits of the result can be used."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.cumprod(np.full(max(n, 64), _STEP), dtype=np.uint64)
    return _POWERS


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (run of bytes that are not white space), and each text's first word."""
    data = np.frombuffer(b"\n".join([b"", *texts, b""]), np.uint8)
    white = WHITE[data]
    first = np.empty(len(data), bool)
    first[0] = False
    np.logical_and(~white[1:], white[:-1], out=first[1:])
    starts = np.flatnonzero(first)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    bounds = np.concatenate([[0], np.searchsorted(starts, ends)])
    if not len(starts):
        return np.zeros(0, np.uint64), bounds
    letters = np.flatnonzero(~white)
    size = np.diff(np.append(np.searchsorted(letters, starts), len(letters)))
    place = np.arange(len(letters)) - np.repeat(np.cumsum(size) - size, size)
    value = _BYTE[data[letters]] * powers(int(size.max()))[place]
    return mix(np.add.reduceat(value, np.cumsum(size) - size)), bounds


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; shorter by k - 1 than ``words``."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = words[:n] * _PLACES[0]
    for j in range(1, k):
        total += words[j : n + j] * _PLACES[j]
    return mix(total)


def positions_left(bounds: np.ndarray) -> np.ndarray:
    """For every word, the words from it to the end of its text, itself included."""
    size = np.diff(bounds)
    return np.repeat(bounds[1:], size) - np.arange(bounds[0], bounds[-1])


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that a worker holds few texts as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about ``limit`` bytes, one text at least."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= limit):
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


def smallest_labels(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, label``: the smallest node reachable over undirected edges, for nodes with edges.

    A node takes the smallest label around it, then the label of that label, until nothing
    changes; chains shrink geometrically. The minimum combines map-side and joins split hot nodes.
    Rounds are written to the shared folder, so no lineage grows.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = written(both.union(both.select("other", "node")).where("node <> other").distinct(), "edges")
    labels = written(both.groupBy("node").agg(F.min(F.least("node", "other")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), F.col("label").alias("offer")), "other")
        near = near.groupBy("node").agg(F.min("offer").alias("offer"))
        step = labels.join(near, "node").select("node", F.col("label").alias("before"), F.least("label", "offer").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        step = step.join(jump, "label", "left").select("node", "before", F.least("label", "further").alias("label"))
        step = written(step, "labels")
        changed = step.where("before <> label").limit(1).count()
        labels = step.select("node", "label")
        if not changed:
            return labels
