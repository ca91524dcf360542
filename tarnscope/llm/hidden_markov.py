"""Language model scoring: a hidden Markov model over words, trained by Baum-Welch."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log10
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnscope.llm.common import dropped, sliced, small_batches, written
from tarnscope.llm.near_dedup import text_bytes

STATES = 8
# The commonest words, at most so many, have their emissions in the model that every task gets. The others
# have theirs in buckets by a hash of the word, which packs of texts ask. Where an emission lies changes no result.
HEAD = 50_000
# Words with emissions of their own in the first guess of the model; after one iteration all have them.
COMMON = 2_000
ITERATIONS = 3
# Rounds of the first guess at most, and the gain of a round, as a share of the log probability, that ends them.
ROUNDS, GAIN = 20, 1e-4
ADD = 0.1
# The recursions are scaled once in so many tokens, and tokens of texts that are run through them together.
RESCALE = 8
TOGETHER = 200_000
# Texts lie in packs of about so many tokens; a longer text is a pack of its own.
PACK = 1_000_000
# Words that all packs together ask of one bucket, about, and buckets at least.
ASKED, BUCKETS = 500_000, 64
# Counts of the head travel in so many slices, and are added up in so many groups before those are.
SLICES, GROUPS = 32, 32
# Expected counts travel as whole numbers of 1 / UNIT, so their sums depend on no order.
UNIT = 1 << 20
COUNTS = ", ".join(f"c{s} double" for s in range(STATES))
PACKED = "pack long, doc_id array<long>, held_out array<boolean>, learn array<boolean>, lengths binary, tokens binary, places binary, words binary, sizes binary"
# What a pack says to a bucket of the words it has there, and what it hears of them: their numbers there and
# their counts. Without a pack: sums over a bucket, or counts of a slice of the head (buckets below 0).
MESSAGE = "bucket int, pack long, ids binary, counts binary"


@dataclass
class Model:
    start: np.ndarray  # states
    move: np.ndarray  # states by states
    emit: np.ndarray  # tokens by states: head words, a place for words outside of the head, end


def count_words(texts: DataFrame) -> DataFrame:
    """``word, n`` over all ``text`` of the table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for text in text_bytes(batch.column("text")):
                found.update(text.lower().split())
            yield pa.record_batch({"word": pa.array(list(found), pa.binary()), "n": pa.array(list(found.values()), pa.int64())})

    return texts.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def head_words(vocabulary: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The commonest words, ``most`` at the most: those with at least a count that so many reach."""
    level = F.greatest(F.lit(0), F.floor(F.log2("n")) - 9)
    step = F.pow(F.lit(2), level).cast("long")
    floors = vocabulary.groupBy((F.floor(F.col("n") / step) * step).alias("floor")).agg(F.count("*").alias("words")).collect()
    least, words = None, 0
    for r in sorted(floors, key=lambda r: -r["floor"]):
        words += r["words"]
        if words > most:
            break
        least = r["floor"]
    if least is None:
        return []
    return sorted(((bytes(r["word"]), r["n"]) for r in vocabulary.where(F.col("n") >= least).collect()), key=lambda x: (-x[1], x[0]))


def squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def whole(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def planes(numbers: np.ndarray) -> bytes:
    """Whole numbers from 0 on byte by byte, all lowest bytes first, in as many bytes as the largest has."""
    numbers = np.ascontiguousarray(numbers, np.int64).reshape(-1)
    width = max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + squeezed(np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())


def of_planes(data: bytes) -> np.ndarray:
    parts = np.frombuffer(whole(data[1:]), np.uint8).reshape(data[0], -1)
    numbers = np.zeros((parts.shape[1], 8), np.uint8)
    numbers[:, : data[0]] = parts.T
    return numbers.view(np.int64).reshape(-1)


class Numbers(dict):
    """Numbers of words; a new word gets the next one."""

    def __init__(self, head: list[bytes]):
        super().__init__((w, i) for i, w in enumerate(head))
        self.next, self.own = len(head) + 2, []

    def __missing__(self, word: bytes) -> int:
        self[word] = number = self.next + len(self.own)
        self.own.append(word)
        return number

    def forget(self) -> None:
        for word in self.own:
            del self[word]
        self.own = []


def encode_tokens(documents: DataFrame, head: list[bytes], buckets: int) -> DataFrame:
    """Packs of texts: tokens as 16-bit numbers; the distinct words outside of the head by bucket and bytes,
    how many of them are in each bucket, and which of them each such token is."""
    shared = documents.sparkSession.sparkContext.broadcast(head)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = Numbers(shared.value)
        size = number.next
        rows: list[tuple] = []
        parts: list[np.ndarray] = []

        def output() -> pa.RecordBatch:
            words = np.empty(len(number.own), object)
            words[:] = number.own
            order = np.asarray(pc.sort_indices(pa.array(number.own, pa.binary()))).astype(np.int64)
            of = np.array([*map(crc32, number.own)], np.int64)[order] % buckets
            order = order[np.argsort(of, kind="stable")]
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order))
            flat = np.concatenate(parts)
            far = flat >= size
            columns = {
                "pack": [rows[0][0]], "doc_id": [[r[1] for r in rows]], "held_out": [[r[2] for r in rows]], "learn": [[r[3] for r in rows]],
                "lengths": [squeezed(np.array([len(x) for x in parts], np.int32).tobytes())], "tokens": [squeezed(np.where(far, size - 2, flat).astype(np.uint16).tobytes())],
                "places": [squeezed(rank[flat[far] - size].tobytes())], "words": [squeezed(b"\n".join(words[order]))], "sizes": [np.bincount(of, minlength=buckets).astype(np.int32).tobytes()],
            }
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.bool_()), *[pa.binary()] * 5)
            number.forget()
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns.values(), kinds, strict=True)], list(columns))

        held = 0
        for batch in sliced(batches):
            for row, text in zip(zip(*(batch.column(c).to_pylist() for c in ("uid", "doc_id", "held_out", "learn")), strict=True), text_bytes(batch.column("text")), strict=True):
                words = text.lower().split()
                if rows and held + len(words) >= PACK:
                    yield output()
                    rows, parts, held = [], [], 0
                parts.append(np.fromiter((*map(number.__getitem__, words), size - 1), np.int32, len(words) + 1))
                rows.append(row)
                held += len(words) + 1
        if rows:
            yield output()

    return documents.select("uid", "doc_id", "held_out", "learn", "text").mapInArrow(encode, PACKED)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i].as_py() for c in batch.schema.names}


def texts_of(row: dict, size: int) -> list[np.ndarray]:
    """The texts of a pack, in tokens of the head and, from ``size`` on, words outside of it."""
    flat = np.frombuffer(whole(row["tokens"]), np.uint16).astype(np.int32)
    if row.get("places") is not None:
        flat[flat == size - 2] = np.frombuffer(whole(row["places"]), np.int32) + size
    return np.split(flat, np.cumsum(np.frombuffer(whole(row["lengths"]), np.int32))[:-1])


def stepwise(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts one after another, the longest first: how many have a token at each step, and of all tokens by
    step their places and their texts."""
    alive = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
    text = np.arange(lengths.sum()) - np.repeat(np.cumsum(alive) - alive, alive)
    return alive, (np.cumsum(lengths) - lengths)[text] + np.repeat(np.arange(len(alive)), alive), text


def forwards(start: np.ndarray, move: np.ndarray, seen: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward recursion over whole texts, scaled at every ``RESCALE``-th token, and the scales of all tokens.
    ``seen``: the emissions, states by the tokens of all texts, step by step."""
    forward, scale, turned, a = np.empty_like(seen), np.ones(seen.shape[1]), np.ascontiguousarray(move.T), 0
    for t, m in enumerate(alive.tolist()):
        here = forward[:, a : a + m]
        np.multiply(turned @ now[:, :m] if t else start[:, None], seen[:, a : a + m], out=here)
        if t % RESCALE == RESCALE - 1:
            scale[a : a + m] = here.sum(axis=0)
            here /= scale[a : a + m]
        now, a = here, a + m
    return forward, scale


def posteriors(start: np.ndarray, move: np.ndarray, seen: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """State probabilities of every token and the expected moves, by the scaled forward and backward
    recursions over whole texts."""
    forward, scale = forwards(start, move, seen, alive)
    back, steps, a = np.ones_like(seen), alive.tolist(), seen.shape[1]
    for t in range(len(steps) - 1, 0, -1):
        m, before = steps[t], steps[t - 1]
        a -= m
        here = move @ (seen[:, a : a + m] * back[:, a : a + m])
        if t % RESCALE == 0:
            here /= here.sum(axis=0)
        back[:, a - before : a - before + m] = here
    state = forward * back
    total = state.sum(axis=0)
    state /= total
    # A move to a token: what came before it, times the emission of the token and all that follows.
    total *= scale
    back *= seen
    back /= total
    later = np.arange(steps[0], seen.shape[1])
    earlier = later - np.repeat(alive[:-1], alive[1:])
    moves = np.zeros_like(move)
    for i in range(0, len(later), 50_000):
        moves += forward[:, earlier[i : i + 50_000]] @ back[:, later[i : i + 50_000]].T
    return state, moves * move


def emitted(model: Model, flat: np.ndarray) -> np.ndarray:
    """Emissions of tokens, states by tokens."""
    seen = np.empty((model.emit.shape[1], len(flat)))
    for s, row in enumerate(seen):
        np.take(model.emit[:, s], flat, out=row, mode="clip")
    return seen


def together(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Texts by falling length, in groups of about ``TOGETHER`` tokens."""
    order = np.argsort(-lengths, kind="stable")
    part = (np.cumsum(lengths[order]) - lengths[order]) // TOGETHER
    for end in np.flatnonzero(np.append(np.diff(part), 1)):
        yield order[np.searchsorted(part, part[end]) : end + 1]


def expected_counts(model: Model, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, moves and emissions of texts whose tokens are all in the model."""
    size, k = model.emit.shape
    starts, moves, emits = np.zeros(k), np.zeros((k, k)), np.zeros((k, size))
    lengths = np.array([len(x) for x in texts])
    for group in together(lengths):
        alive, places, _ = stepwise(lengths[group])
        flat = np.concatenate([texts[i] for i in group])[places].astype(np.int64)
        own, step = posteriors(model.start, model.move, emitted(model, flat), alive)
        starts += own[:, : alive[0]].sum(axis=1)
        moves += step
        for s in range(k):
            emits[s] += np.bincount(flat, own[s], size)
    return starts, moves, emits.T


@dataclass
class Smoothing:
    """What turns the expected counts of a word in the states, the same for all words, into its emissions."""

    kinds: np.ndarray  # states
    total: np.ndarray  # states
    tokens: float  # N + ADD * (V + 1)

    def emissions(self, counts: np.ndarray) -> np.ndarray:
        """Rows of counts by state. A word occurs as often as its counts add up to."""
        overall = (counts.sum(axis=-1, keepdims=True) + ADD) / self.tokens
        return (counts + self.kinds * overall) / (self.total + self.kinds)


def cluster_round(encoded: DataFrame, place: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, float]:
    """One round of a mixture of states over all learning texts: the expected counts of the commonest words by state,
    and the log probability of those words. Every task adds up its own, Spark adds up those of all tasks.

    ``place`` says for every token of the head which of the commonest words it is, or -1.
    """
    shared = encoded.sparkSession.sparkContext.broadcast((place, np.log(shares / shares.sum(axis=0))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, logs = shared.value
        size, k = logs.shape
        sums = np.zeros((size + 1, k))
        for row in rows_of(batches):
            lengths = np.frombuffer(whole(row["lengths"]), np.int32)
            found = of[np.frombuffer(whole(row["tokens"]), np.uint16)]
            learn, ends = np.array(row["learn"]), np.cumsum(lengths)
            for i in range(0, len(lengths), 500):
                n = len(lengths[i : i + 500])
                at = found[ends[i] - lengths[i] : ends[i + n - 1]]
                text = np.repeat(np.arange(n), lengths[i : i + n])
                use = (at >= 0) & learn[i : i + n][text]
                table = np.bincount(text[use] * size + at[use], minlength=n * size).reshape(n, size).astype(float)[learn[i : i + n]]
                score = table @ logs
                top = score.max(axis=1, keepdims=True)
                own = np.exp(score - top)
                total = own.sum(axis=1, keepdims=True)
                sums[size, 0] += (np.log(total) + top).sum()
                sums[:size] += table.T @ (own / total)
        full = np.flatnonzero(sums.any(axis=1))
        yield pa.record_batch([pa.array(full, pa.int32()), *(pa.array(np.ascontiguousarray(sums[full, s])) for s in range(k))], ["token", *(f"c{s}" for s in range(k))])

    found = encoded.select("learn", "lengths", "tokens").mapInArrow(count, f"token int, {COUNTS}").groupBy("token").agg(*[F.sum(f"c{s}").alias(f"c{s}") for s in range(STATES)])
    sums = np.zeros((len(shares) + 1, STATES))
    for r in found.collect():  # one row for each of the commonest words at most
        sums[r["token"]] = [r[f"c{s}"] for s in range(STATES)]
    return sums[:-1], sums[-1, 0]


def first_model(encoded: DataFrame, counts: np.ndarray, rare: int, rest: float, rest_words: int) -> tuple[Model, np.ndarray]:
    """States start as clusters of all learning texts by the commonest words; the clusters start as the words' shares,
    each changed by chance. All other words start without a state: returned is also the emission of a word, by
    its states, for each of its smoothed occurrences.

    ``rest`` and ``rest_words`` count the tokens and words outside of the head.
    """
    k = STATES
    order = np.argsort(-np.where(np.arange(len(counts)) == rare, -1.0, counts), kind="stable")
    common = order[order != rare][:COMMON]
    place = np.full(len(counts), -1)
    place[common] = np.arange(len(common))
    shares = (counts[common, None] + 1e-2) * np.exp(np.random.default_rng(3).normal(0, 0.5, (len(common), k)))
    before = None
    for _ in range(ROUNDS if counts.sum() else 0):
        found, now = cluster_round(encoded, place, shares)
        shares = found + 1e-2
        if before is not None and now - before <= GAIN * abs(now):
            break
        before = now
    shares = shares + counts[common, None] / max(counts.sum() + rest, 1) * 50
    others = np.setdiff1d(np.arange(len(counts)), [*common, rare])
    left = rest + counts[others].sum() + ADD * (rest_words + len(others) + 1)
    part = (counts[common].sum() + ADD) / (counts[common].sum() + ADD + left)
    emit = np.zeros((len(counts), k))
    emit[common] = shares / shares.sum(axis=0) * part
    free = np.full(k, (1 - part) / left)
    emit[others] = (counts[others, None] + ADD) * free
    moves = np.full((k, k), 1.0) + np.eye(k) * 9 * k
    return Model(np.full(k, 1 / k), moves / moves.sum(axis=1, keepdims=True), emit), free


def said(pack: int | None, sizes: np.ndarray, ids: list[bytes | None], counts: np.ndarray) -> pa.RecordBatch:
    """Messages of a pack to the buckets in which it has words, with whole counts by word and state."""
    ends = np.cumsum(sizes)
    full = np.flatnonzero(sizes)
    return pa.record_batch([pa.array(full, pa.int32()), pa.array([pack] * len(full), pa.int64()), pa.array(ids, pa.binary()), pa.array([planes(counts[ends[b] - sizes[b] : ends[b]].T) for b in full], pa.binary())], ["bucket", "pack", "ids", "counts"])


def heard(bucket: int, packs: list[int | None], ids: list[bytes | None], counts: list[bytes]) -> pa.Table:
    return pa.table([pa.array([bucket] * len(packs), pa.int32()), pa.array(packs, pa.int64()), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], ["bucket", "pack", "ids", "counts"])


def learnt_words(encoded: DataFrame, size: int) -> DataFrame:
    """For every pack the numbers of its words outside of the head in their buckets, and how often each is in
    the learning texts, put down in one state."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            sizes = np.frombuffer(row["sizes"], np.int32)
            if not sizes.any():
                continue
            words, ends = whole(row["words"]).split(b"\n"), np.cumsum(sizes)
            counts = np.zeros((len(words), STATES), np.int64)
            learning = [t for t, learn in zip(texts_of(row, size), row["learn"], strict=True) if learn]
            if learning:
                counts[:, 0] = np.bincount(np.concatenate(learning), minlength=size + len(words))[size:] * UNIT
            yield said(row["pack"], sizes, [squeezed(b"\n".join(words[ends[b] - sizes[b] : ends[b]])) for b in np.flatnonzero(sizes)], counts)

    def number(group: pa.Table) -> pa.Table:
        asked = pc.split_pattern(pa.array([whole(x) for x in group["ids"].to_pylist()], pa.large_binary()), b"\n")
        coded = asked.values.dictionary_encode()
        order = np.asarray(pc.sort_indices(coded.dictionary))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        ids = np.split(rank[np.asarray(coded.indices)], np.asarray(asked.offsets)[1:-1])
        return added(group["bucket"][0].as_py(), group["pack"].to_pylist(), [planes(np.diff(x, prepend=0)) for x in ids], group["counts"].to_pylist())

    asked = encoded.select("pack", "learn", "lengths", "tokens", "places", "words", "sizes").mapInArrow(ask, MESSAGE)
    return written(asked.groupBy("bucket").applyInArrow(number, MESSAGE), "counts", once=True).where("pack IS NOT NULL")


def added(bucket: int, packs: list[int | None], ids: list[bytes | None], counts: list[bytes]) -> pa.Table:
    """The answers of a bucket to all packs, and without a pack the sum over its words of their counts and of
    their counts up to 1; of a slice of the head only the sum of its counts."""
    if bucket < 0:
        return heard(bucket, [None], [None], [planes(sum(of_planes(c) for c in counts))])
    numbers = [np.cumsum(of_planes(x)) for x in ids]
    sums = np.zeros((STATES, 1 + max(int(x[-1]) for x in numbers)), np.int64)
    for at, said_counts in zip(numbers, counts, strict=True):
        sums[:, at] += of_planes(said_counts).reshape(STATES, -1)
    stats = np.stack([sums.sum(axis=1), np.minimum(sums, UNIT).sum(axis=1)])
    return heard(bucket, [None, *packs], [None, *ids], [planes(stats), *(planes(sums[:, at]) for at in numbers)])


def add_up(group: pa.Table) -> pa.Table:
    return added(group["bucket"][0].as_py(), *(group[c].to_pylist() for c in ("pack", "ids", "counts")))


def with_tails(encoded: DataFrame, tails: DataFrame) -> DataFrame:
    """``encoded`` with ``own``, what a pack heard of its words from the buckets, in their order."""
    met = tails.groupBy("pack").agg(F.sort_array(F.collect_list(F.struct("bucket", "ids", "counts"))).alias("own"))
    return encoded.join(met, "pack", "left")


def counts_of(row: dict) -> np.ndarray:
    """Counts by state of the words of a pack that are outside of the head."""
    parts = [of_planes(x["counts"]).reshape(STATES, -1) for x in row["own"] or []]
    return np.concatenate(parts, axis=1).T / UNIT if parts else np.zeros((0, STATES))


def model_of(model: Model, smoothing: Smoothing | None, free: np.ndarray, counts: np.ndarray) -> Model:
    """The model with the words of a pack behind those of the head."""
    tail = smoothing.emissions(counts) if smoothing is not None else (counts.sum(axis=1, keepdims=True) + ADD) * free
    return Model(model.start, model.move, np.vstack([model.emit, tail]))


def baum_welch(encoded: DataFrame, tails: DataFrame, model: Model, free: np.ndarray, smoothing: Smoothing | None, tokens: float) -> tuple[Model, Smoothing, DataFrame]:
    """One iteration over all learning texts. Every pack hears the counts of its words, and says to their buckets
    what it expects in its texts; a task says so of head words once. The buckets add up and answer. The counts of
    head words reach the driver, all others stay a table."""
    shared = encoded.sparkSession.sparkContext.broadcast((model, free, smoothing))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, start_free, smooth = shared.value
        size, k = current.emit.shape
        head, group = np.zeros((size + 1 + k, k)), 0
        for row in rows_of(batches):
            group = row["pack"] % GROUPS
            counts = counts_of(row)
            learning = [t for t, learn in zip(texts_of(row, size), row["learn"], strict=True) if learn]
            emits = np.zeros((size + len(counts), k))
            if learning:
                starts, moves, emits = expected_counts(model_of(current, smooth, start_free, counts), learning)
                head[:size] += emits[:size]
                head[size] += starts
                head[size + 1 :] += moves
            if len(counts):
                sizes = np.zeros(row["own"][-1]["bucket"] + 1, np.int64)
                for x in row["own"]:
                    sizes[x["bucket"]] = len(of_planes(x["ids"]))
                yield said(row["pack"], sizes, [x["ids"] for x in row["own"]], np.rint(emits[size:] * UNIT).astype(np.int64))
        if head.any():
            slices = np.array_split(np.rint(head * UNIT).astype(np.int64), SLICES)
            yield pa.record_batch([pa.array([-1 - (i * GROUPS + group) for i in range(SLICES)], pa.int32()), pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.binary()), pa.array([planes(x.T) for x in slices], pa.binary())], ["bucket", "pack", "ids", "counts"])

    texts = with_tails(encoded.select("pack", "learn", "lengths", "tokens", "places"), tails)
    found = written(texts.mapInArrow(count, MESSAGE).groupBy("bucket").applyInArrow(add_up, MESSAGE), "counts", once=True)
    size, k = model.emit.shape
    # One row for each slice of the head; one for each bucket.
    slices = found.where("bucket < 0").withColumn("bucket", -1 - F.floor((-1 - F.col("bucket")) / GROUPS).cast("int")).groupBy("bucket").applyInArrow(add_up, MESSAGE).collect()
    head = np.concatenate([of_planes(bytes(r["counts"])).reshape(k, -1).T for r in sorted(slices, key=lambda r: -r["bucket"])]) / UNIT
    sums = sum((of_planes(bytes(r["counts"])).reshape(2, k) for r in found.where("bucket >= 0 AND pack IS NULL").select("counts").collect()), np.zeros((2, k))) / UNIT
    emits = head[:size]
    kinds = 2 * (np.minimum(emits, 1).sum(axis=0) + sums[1]) + 1
    smooth = Smoothing(kinds, emits.sum(axis=0) + sums[0], tokens)
    starts, moves = head[size], head[size + 1 :]
    return Model((starts + 1) / (starts.sum() + k), (moves + 1) / (moves.sum(axis=1, keepdims=True) + k), smooth.emissions(emits)), smooth, found.where("pack IS NOT NULL")


def log_likelihoods(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """Exact log10 probability of every whole sequence of tokens that are all in the model."""
    lengths, out = np.array([len(x) for x in texts]), np.zeros(len(texts))
    for group in together(lengths):
        alive, places, text = stepwise(lengths[group])
        flat = np.concatenate([texts[i] for i in group])[places]
        forward, scale = forwards(model.start, model.move, emitted(model, flat), alive)
        ends = np.flatnonzero(places == (np.cumsum(lengths[group]) - 1)[text])
        scale[ends] *= forward[:, ends].sum(axis=0)
        out[group] = np.bincount(text, np.log10(scale), len(group))
    return out


def score_texts(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", held_out: Column, iterations: int = ITERATIONS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``, one row per row of
    ``documents``; rows with ``held_out`` false are learnt from, those where it is null neither.

    Tokens are words with A-Z in lower case, then one end. Words are counted over all learning texts, and
    every one of them has emissions of its own in every latent state, from its expected counts, which lean on
    its overall share. Those of the commonest words are sent to the tasks; all others lie in buckets, which packs of
    texts ask in every iteration. What an iteration wrote is deleted once the next one is done. The first guess of the states and Baum-Welch run over all learning texts, whole; counts are added up across partitions in doubles. ``score`` is
    the log10 probability of the whole text, ``base_score`` that of single words with ``ADD`` added to their counts.

    Null and empty texts have one token, the end. A null id is kept, and what ``held_out`` says of it counts.
    Repeated rows are counted and scored one by one. Without learning texts all words are equally unknown.
    Very long texts are scored whole, at about 350 bytes of memory a token; other columns are ignored; an
    empty table gives no rows.
    """
    rows = documents.select(F.monotonically_increasing_id().alias("uid"), F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(~held_out, F.lit(False)).alias("learn"), F.col(text).alias("text"))
    small_batches(documents.sparkSession)
    vocabulary = written(count_words(rows.where("learn")), "vocabulary", once=True)
    totals = vocabulary.agg(F.count("*").alias("words"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).collect()[0]
    learnt = rows.where("learn").count()
    head = head_words(vocabulary, HEAD)
    dropped(vocabulary)
    n, v = totals["tokens"] + learnt, totals["words"] + (learnt > 0)
    total = n + ADD * (v + 1)
    rest = totals["tokens"] - sum(c for _, c in head)
    encoded = written(encode_tokens(rows, [w for w, _ in head], max(BUCKETS, ceil(rest / ASKED))), "tokens", once=True)
    rare = len(head)
    counts = np.array([*(c for _, c in head), 0, learnt], float)
    model, free = first_model(encoded, counts, rare, rest, totals["words"] - rare)
    smoothing, tails = None, learnt_words(encoded, rare + 2)
    for _ in range(iterations if learnt else 0):
        model, smoothing, fresh = baum_welch(encoded, tails, model, free, smoothing, total)
        dropped(tails)
        tails = fresh
    shared = documents.sparkSession.sparkContext.broadcast((model, free, smoothing, counts))
    base_all = log10(total)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, start_free, smooth, seen_counts = shared.value
        size = len(seen_counts)
        for row in rows_of(batches):
            own = counts_of(row)
            times = np.concatenate([seen_counts, np.rint(own.sum(axis=1))])
            texts = texts_of(row, size)
            lengths = np.array([len(t) for t in texts])
            flat, first = np.concatenate(texts), np.cumsum(lengths) - lengths
            yield pa.record_batch({
                "doc_id": pa.array(row["doc_id"], pa.int64()), "held_out": pa.array(row["held_out"], pa.bool_()), "n_tokens": pa.array(lengths, pa.int64()),
                "n_known": pa.array(np.add.reduceat((times > 0).astype(np.int64)[flat], first)), "base_score": pa.array(np.add.reduceat(np.log10(times + ADD)[flat], first) - lengths * base_all),
                "score": pa.array(log_likelihoods(model_of(fitted, smooth, start_free, own), texts)),
            })

    scored = with_tails(encoded.select("pack", "doc_id", "held_out", "lengths", "tokens", "places"), tails)
    scored = scored.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
