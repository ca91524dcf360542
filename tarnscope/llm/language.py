"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnscope.llm.common import sliced, with_fields

BITS = 17
SIZES = (1, 2, 3)
UNKNOWN = "und"
# Shares of n-grams are small; this brings inputs near unit length.
SCALE = 10.0
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))
_LETTER: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)
    return _LETTER


def grams_of(text: str | None) -> np.ndarray:
    """Buckets of all 1- to 3-grams of the lower-cased text; what is no letter counts as a blank.
    Empty for a text without letters."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letter_table()[points]
    if not letter.any():
        return np.zeros(0, np.int64)
    points = np.concatenate([np.zeros(1, np.uint32), np.where(letter, points, 0).astype(np.uint32), np.zeros(1, np.uint32)])
    points = points[np.concatenate([[True], (points[1:] != 0) | (points[:-1] != 0)])]
    out, value = [], np.zeros(len(points), np.uint32)
    for n in SIZES:
        value = (value[: len(points) - n + 1] * np.uint32(31) + points[n - 1 :] + np.uint32(n)) * _MIX[n - 1]
        out.append(value ^ (value >> np.uint32(15)))
    return (np.concatenate(out) >> np.uint32(32 - BITS)).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # buckets by languages, IDF times weight
    bias: np.ndarray
    temperature: float

    def scores(self, grams: np.ndarray) -> np.ndarray:
        """Probability of every language. Term frequencies are shares of the text's n-grams."""
        z = (self.weights[grams].sum(axis=0, dtype=np.float64) / len(grams) + self.bias) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def document_frequencies(documents: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """Number of texts that hold each n-gram bucket, over all of them, and the number of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << BITS, np.int64), 0
        seen = np.full(1 << BITS, -1, np.int64)
        for batch in sliced(batches):
            for value in batch.column(0).to_pylist():
                grams = grams_of(value)
                if len(grams):
                    seen[grams] = np.arange(len(grams))
                    total[grams[seen[grams] == np.arange(len(grams))]] += 1
                    n += 1
        full = np.flatnonzero(total)
        yield pa.record_batch({"bucket": pa.array(np.append(full, -1)), "n": pa.array(np.append(total[full], n))})

    rows = documents.select(text).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(1 << BITS)
    texts = 0
    for r in rows:  # one row for each bucket at most
        if r["bucket"] < 0:
            texts = r["n"]
        else:
            out[r["bucket"]] = r["n"]
    return out, texts


def fit_ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], n_classes: int, *, rounds: int = 6, alpha: float = 1.0, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Follow the regularised leader, proximal, per coordinate: ``z`` and ``n`` gather gradients, and
    the weights follow from them with the elastic-net penalty. Returns weights and bias."""
    size = 1 << BITS
    z, n = np.zeros((size + 1, n_classes)), np.zeros((size + 1, n_classes))

    def weights(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        return np.where(np.abs(zs) > l1, (np.sign(zs) * l1 - zs) / ((beta + np.sqrt(n[at])) / alpha + l2), 0.0)

    order = np.random.default_rng(7)
    for _ in range(rounds):
        for i in order.permutation(len(examples)):
            buckets, values, label = examples[i]
            at, x = np.append(buckets, size), np.append(values, 1.0)
            w = weights(at)
            score = x @ w
            p = np.exp(score - score.max())
            p /= p.sum()
            p[label] -= 1
            g = x[:, None] * p[None, :]
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    whole = weights(np.arange(size + 1))
    return whole[:size], whole[size]


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """Temperature with the smallest log-loss, by golden section on its logarithm."""

    def loss(t: float) -> float:
        s = logits / np.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), labels]))

    low, high, ratio = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train_languages(labelled: DataFrame, *, text: str = "text", lang: str = "lang", sample_rows: int = 3_000) -> Model | None:
    """Fit a model on rows with text and label; None if there are none with a letter.

    Document frequencies are counted over all rows. Weights are fitted on about ``sample_rows`` rows,
    an equal share for every label, chosen by a hash of the text: the n-gram counts of these whole
    texts are what the driver gets. A fifth of them is left out of the fit and sets the temperature.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return None
    frequency, texts = document_frequencies(rows, "text")
    if not texts:
        return None
    quota = sample_rows / len(sizes)
    chosen = F.lit(False)
    for name, n in sizes.items():
        chosen = chosen | ((F.col("lang") == name) & (F.pmod(F.xxhash64("text"), F.lit(1_000_003)) <= int(1_000_003 * min(1.0, quota / n))))
    languages = sorted(sizes)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = []
            for t, label in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                bucket, n = np.unique(grams_of(t), return_counts=True)
                if len(bucket):
                    out.append((bucket.tolist(), (n / n.sum()).tolist(), label, hash((len(t), int(bucket.sum()))) % 5))
            yield pa.record_batch([pa.array([o[i] for o in out], kind) for i, kind in enumerate((pa.list_(pa.int32()), pa.list_(pa.float32()), pa.string(), pa.int32()))], ["buckets", "shares", "lang", "part"])

    sample = rows.where(chosen).mapInArrow(features, "buckets array<int>, shares array<float>, lang string, part int").toArrow()
    idf = (np.log((1 + texts) / (1 + frequency)) + 1).astype(np.float64)
    examples, parts = [], []
    for b, s, name, part in zip(sample["buckets"], sample["shares"], sample["lang"].to_pylist(), sample["part"].to_pylist(), strict=True):
        at = b.values.to_numpy().astype(np.int64)
        examples.append((at, s.values.to_numpy().astype(np.float64) * idf[at] * SCALE, languages.index(name)))
        parts.append(part)
    order = sorted(range(len(examples)), key=lambda i: (parts[i], len(examples[i][0]), examples[i][0].sum(), examples[i][2]))
    fit = [examples[i] for i in order if parts[i]] or examples
    weights, bias = fit_ftrl(fit, len(languages))
    held = [examples[i] for i in order if not parts[i]] or examples
    logits = np.array([x @ weights[at] + bias for at, x, _ in held])
    temperature = fit_temperature(logits, np.array([label for _, _, label in held]))
    return Model(languages, (weights * idf[:, None] * SCALE).astype(np.float32), bias, temperature)


def identify_languages(documents: DataFrame, model: Model | None, *, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` (its calibrated probability) to every row, from the whole text.

    Null and empty texts and texts without a letter are ``und`` with score 1, as is every text if there
    is no model. Equal scores take the first language by name. Repeated rows are predicted one by one.
    All other columns stay; columns of these names are replaced. The model has a fixed number of
    buckets for every language, whatever the number of texts.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    out = documents.drop("lang_pred", "score")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in sliced(batches):
            said, score = [], []
            for value in batch.column(text).to_pylist():
                grams = grams_of(value)
                p = fitted.scores(grams) if fitted is not None and len(grams) else None
                said.append(UNKNOWN if p is None else fitted.languages[int(p.argmax())])
                score.append(1.0 if p is None else float(p.max()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, pa.string()), pa.array(score)], [*batch.schema.names, "lang_pred", "score"])

    return out.mapInArrow(predict, with_fields(out, lang_pred=T.StringType(), score=T.DoubleType()))


def accepted(lang_pred: Column, score: Column, least: float = 0.5) -> Column:
    """Documents in a learned language that the model is sure enough of."""
    return (lang_pred != UNKNOWN) & (score >= least)
