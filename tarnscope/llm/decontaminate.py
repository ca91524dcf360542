"""Benchmark decontamination by winnowed fingerprints, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnscope.llm.common import let, lower_ascii, written

# A word is a run of digits, letters a-z and characters beyond ASCII.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
GRAM = 5
# A side of at most so many fingerprints (16 bytes each) is broadcast; beyond it the join shuffles.
BROADCAST_FINGERPRINTS = 1_000_000


def words_of(text: Column) -> Column:
    """Lower-cased words; null text has none."""
    return F.filter(F.split(F.coalesce(lower_ascii(text), F.lit("")), BREAKS, -1), lambda w: w != "")


def gram_size(window: int, gram: int = GRAM) -> int:
    return min(gram, window)


def grams(words: Column, k: int) -> Column:
    """Hash of the k words from each position on."""
    return F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: F.xxhash64(F.slice(words, i, k)))


def fingerprints(hashes: Column, width: int) -> Column:
    """Smallest of ``width`` neighbouring hashes, for every position: the winnowed fingerprint of
    the window that starts there."""
    if width == 1:
        return hashes
    return F.transform(F.sequence(F.lit(1), F.size(hashes) - width + 1), lambda i: F.array_min(F.slice(hashes, i, width)))


def windows_of(words: str, window: int) -> Column:
    """Fingerprint of every window of ``window`` words; empty for shorter texts."""
    k = gram_size(window)
    prints = let(grams(F.col(words), k), lambda h: fingerprints(h, window - k + 1))
    return F.when(F.size(words) >= window, prints).otherwise(F.array().cast("array<bigint>"))


def window_text(words: Column, start: Column, window: int) -> Column:
    return F.array_join(F.slice(words, start, window), " ")


def benchmark_windows(items: DataFrame, item_id: str, text: str, window: int = WINDOW) -> DataFrame:
    """Distinct ``size, print, gram, item`` of all item windows; a short item is one window."""
    rows = items.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(text)).alias("words"))
    rows = rows.where(F.size("words") > 0).withColumn("size", F.least(F.size("words"), F.lit(window)))
    parts = []
    for size in sorted(r["size"] for r in rows.select("size").distinct().collect()):
        starts = rows.where(F.col("size") == size).withColumn("prints", windows_of("words", size))
        starts = starts.select("item", "words", F.posexplode("prints").alias("at", "print"))
        parts.append(starts.select(F.lit(size).alias("size"), "print", window_text(F.col("words"), F.col("at") + 1, size).alias("gram"), "item"))
    if not parts:
        return rows.select("size", F.lit(None).cast("bigint").alias("print"), F.lit(None).cast("string").alias("gram"), "item").limit(0)
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.distinct()


def row_id(doc_id: str, text: str) -> Column:
    """Tells rows apart even where an id occurs with several texts, and matches null ids."""
    return F.struct(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("mark"))


def find_contamination(documents: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Words of every document that lie in an occurrence of a benchmark window.

    Winnowing keeps the smallest 5-gram hash of every window of ``window`` words. Equal windows have
    equal fingerprints, so joining the distinct fingerprints of documents and items finds every
    shared window; the texts of the windows at those positions then decide.

    Returns ``row_id, doc_id, n_words, n_hit, items``, one row per row of ``documents``, repeated ones
    included; ``items`` holds the ids as sorted strings. Null and empty texts have no words and no
    hits, in documents as in items; a null item id counts its hits and is named in no list; a null
    document id is scored like any other. Ties do not matter: every equal window counts. An item
    table without words hits nothing. Other columns are ignored.
    """
    bench = written(benchmark_windows(items, item_id, item_text, window), "benchmark")
    prints = bench.select("size", "print").distinct()
    sizes = sorted(r["size"] for r in bench.select("size").distinct().collect())
    small = prints.count() <= BROADCAST_FINGERPRINTS
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    docs = docs.withColumn("row_id", row_id("doc_id", "text"))
    tokens = docs.select("doc_id", "row_id", words_of(F.col("text")).alias("words"))
    kinds = [F.struct(F.lit(s).alias("size"), F.array_distinct(windows_of("words", s)).alias("prints")) for s in sizes]
    base = tokens.select("doc_id", "row_id", F.size("words").cast("long").alias("n_words"))
    if not sizes:
        return base.select("row_id", "doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    found = tokens.select("row_id", F.inline(F.array(*kinds))).select("row_id", "size", F.explode("prints").alias("print"))
    found = found.join(F.broadcast(prints) if small else prints, ["size", "print"]).groupBy("row_id").agg(F.collect_set(F.struct("size", "print")).alias("found"))
    hit = docs.join(found, "row_id").select("row_id", "found", words_of(F.col("text")).alias("words"))
    spots = None
    for size in sizes:
        wanted = F.transform(F.filter("found", lambda f: f["size"] == size), lambda f: f["print"])
        part = hit.select("row_id", "words", wanted.alias("wanted")).where(F.size("wanted") > 0)
        part = part.withColumn("prints", windows_of("words", size))
        at = F.filter(F.transform("prints", lambda p, i: F.when(F.array_contains("wanted", p), i)), lambda i: i.isNotNull())
        grams_at = F.transform(at, lambda i: F.struct(i.alias("at"), window_text(F.col("words"), i + 1, size).alias("gram")))
        part = part.select("row_id", F.lit(size).alias("size"), F.inline(grams_at))
        spots = part if spots is None else spots.union(part)
    spots = spots.groupBy("row_id", "size", "gram").agg(F.collect_list("at").alias("at"))
    by_gram = bench.groupBy("size", "gram").agg(F.collect_set("item").alias("items"))
    spots = spots.join(by_gram, ["size", "gram"])
    whole = spots.groupBy("row_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list(F.transform("at", lambda i: F.struct(i.alias("at"), F.col("size").alias("size"))))).alias("spans"))
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["size"] - 1))))
    whole = whole.select("row_id", "items", F.size(covered).cast("long").alias("n_hit"))
    out = base.join(whole, "row_id", "left")
    return out.select("row_id", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)
