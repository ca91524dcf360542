"""Secret scans: fixed patterns, and character Markov models of random and ordinary strings.

DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnscope.llm.common import let

# The patterns of the base scan. The size limits of access keys and hex strings are
# part of their pattern, since a run that is too short holds no longer one. That of assignments is
# tested afterwards, because a failing match still takes its characters.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")
# Strings that the models judge: runs of these characters, as long as most keys are.
RUN = r"[A-Za-z0-9+/_=-]{20,}"
ORDINARY = r"[A-Za-z0-9+/_=-]{8,}"
ALPHABET = "".join(map(chr, range(33, 127)))
SPAN = "array<struct<kind:int,start:int,end:int>>"


def spans_of(text: Column, pattern: str, kind: int, keep: Callable[[Column], Column] | None = None) -> Column:
    """Spans of all matches, in code points. The text between matches gives their places. ``keep``
    turns the array of matches into one of booleans that says which count."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    size = lambda parts, n: F.aggregate(F.slice(parts, F.lit(1), n), F.lit(0), lambda a, p: a + F.length(p))

    def places(x: Column) -> Column:
        return F.transform(x["hits"], lambda h, i: F.struct(
            F.lit(kind).alias("kind"), (size(x["pieces"], i + 1) + size(x["hits"], i)).alias("start"), (size(x["pieces"], i + 1) + size(x["hits"], i + 1)).alias("end"),
        ))

    def found(h: Column) -> Column:
        span = let(F.struct(h.alias("hits"), F.split(text, pattern, -1).alias("pieces")), places)
        if keep is not None:
            pairs = F.arrays_zip(span.alias("span"), keep(h).alias("keep"))
            span = F.transform(F.filter(pairs, lambda x: x["keep"]), lambda x: x["span"])
        return F.when(F.size(h) > 0, span).otherwise(F.array().cast(SPAN)).cast(SPAN)

    return let(hits, found)


def base_spans(text: Column) -> Column:
    long_enough = lambda hits: F.transform(hits, lambda h: F.length(F.regexp_extract(h, ASSIGN, 2)) >= 6)
    return F.concat(
        spans_of(text, ASSIGN, 0, long_enough), spans_of(text, ACCESS, 1), spans_of(text, HEX, 2)
    )


def by_place(spans: Column) -> Column:
    """Sorted by start, then kind as listed."""
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return F.array_sort(keyed)


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(by_place(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def labelled_samples(documents: DataFrame, text: str, share: Column) -> DataFrame:
    """``random, value``: the values of base matches, and ordinary strings outside of them.

    Ordinary strings come from the documents that ``share`` selects.
    """
    chosen = documents.where(F.col(text).isNotNull())
    values = F.concat(
        F.filter(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= 6),
        F.regexp_extract_all(text, F.lit(ACCESS), F.lit(0)), F.regexp_extract_all(text, F.lit(HEX), F.lit(0)),
    )
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(text), ASSIGN, " "), ACCESS, " "), HEX, " ")
    ordinary = F.filter(F.regexp_extract_all(plain, F.lit(ORDINARY), F.lit(0)), lambda v: v.rlike("^[A-Z]?[a-z_-]+$"))
    return chosen.where(share).select(F.lit(True).alias("random"), F.explode(values).alias("value")).union(
        chosen.where(share).select(F.lit(False).alias("random"), F.explode(ordinary).alias("value"))
    )


def train_markov(samples: DataFrame, smoothing: float = 0.5) -> list[float]:
    """Log-likelihood ratio, random over ordinary, of every pair of neighbouring characters.

    First-order models of both kinds with additive smoothing over the alphabet. The table has one
    entry for every pair of characters, whatever the number of samples.
    """
    pairs = F.transform(F.sequence(F.lit(1), F.length("value") - 1), lambda i: F.substr("value", i, F.lit(2)))
    seen = samples.where(F.length("value") > 1).select("random", F.explode(pairs).alias("pair"))
    rows = seen.groupBy("random", "pair").count().where(F.col("pair").rlike("^[!-~]{2}$")).collect()
    n = len(ALPHABET)
    if len({r["random"] for r in rows}) < 2:
        return [0.0] * n * n
    counts = {True: [[smoothing] * n for _ in range(n)], False: [[smoothing] * n for _ in range(n)]}
    for r in rows:
        counts[r["random"]][ALPHABET.index(r["pair"][0])][ALPHABET.index(r["pair"][1])] += r["count"]
    table = []
    for a in range(n):
        totals = {kind: sum(counts[kind][a]) for kind in counts}
        table += [log(counts[True][a][b] / totals[True]) - log(counts[False][a][b] / totals[False]) for b in range(n)]
    return table


def likelihood_ratio(value: Column, table: Column) -> Column:
    """Mean log-likelihood ratio of a string's character pairs."""
    code = lambda i: F.ascii(F.substr(value, i, F.lit(1))) - 33
    pairs = F.sequence(F.lit(1), F.length(value) - 1)
    total = F.aggregate(pairs, F.lit(0.0), lambda a, i: a + F.get(table, code(i) * len(ALPHABET) + code(i + 1)))
    return total / (F.length(value) - 1)


def scan_secrets(documents: DataFrame, *, text: str = "text", sample_documents: int = 20_000, threshold: float = 0.4, base: str = "base", spans: str = "spans") -> DataFrame:
    """Add ``base`` and ``spans`` (arrays of ``kind, start, end`` in code points) to every row.

    ``base`` holds the matches of the fixed patterns. ``spans`` adds runs of at least 20 key
    characters with letters and digits whose mean log-likelihood ratio, random over ordinary, exceeds
    ``threshold`` and that touch no base span. The models are trained on labelled strings of about
    ``sample_documents`` documents, chosen by a hash of their text.

    Null and empty texts have no spans; very long ones are scanned whole. Repeated rows are scanned
    one by one. Matches of one kind do not overlap, those of two kinds may; at one start they stand in
    the order of kinds. Without samples of both kinds the models add nothing. All other columns stay;
    columns with the names of the results are replaced.
    """
    n = documents.count()
    share = F.pmod(F.xxhash64(text), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample_documents / max(n, 1)))
    table = F.lit(train_markov(labelled_samples(documents.select(text), text, share)))
    whole = F.coalesce(F.col(text), F.lit(""))
    out = documents.withColumn(base, base_spans(whole))
    odd = lambda runs: F.transform(runs, lambda r: r.rlike("[0-9]") & r.rlike("[A-Za-z]") & (likelihood_ratio(r, table) > threshold))
    found = F.filter(spans_of(whole, RUN, 3, odd), lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return out.withColumn(spans, F.concat(base, found))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """Replace every span by ``mark``; spans that overlap are replaced as one."""
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("done"))

    def step(a: Column, s: Column) -> Column:
        fresh = s["start"] >= a["done"]
        before = F.substr(text, a["done"] + 1, s["start"] - a["done"])
        parts = F.when(fresh, F.concat(a["parts"], F.array(before, F.lit(mark)))).otherwise(a["parts"])
        return F.struct(parts.alias("parts"), F.greatest(a["done"], s["end"]).alias("done"))

    joined = F.aggregate(by_place(spans), start, step, lambda a: F.concat(F.array_join(a["parts"], ""), F.substr(text, a["done"] + 1)))
    return F.when(F.size(spans) > 0, joined).otherwise(text)


def secret_counts(scanned: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(span_list(F.col("base")), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans"),
    )
