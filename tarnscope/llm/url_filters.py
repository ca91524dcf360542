"""URL filters by hashed host-suffix and path-prefix expressions, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnscope.llm.common import let, lower_ascii

# Expressions meet rules on the first so many hex digits of their SHA-256; the whole digest confirms.
PREFIX_DIGITS = 8
# A rule list of at most so many bytes of text is broadcast. A longer one is joined by a shuffle, in
# which every expression that many urls share is dealt out to so many places.
BROADCAST_BYTES, SALTS = 4 << 20, 16
HOST = r"://([^/?#]*)"
PATH = r"://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, HOST, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def folder_of(path: Column) -> Column:
    """The path up to its last slash."""
    return F.regexp_extract(path, r"^(?s:.*/)?", 0)


def host_suffixes(host: Column, most: Column | int) -> Column:
    """The last 1, 2, ... labels of a host, ``most`` labels at the longest."""
    return let(F.split(host, r"\.", -1), lambda labels: F.transform(
        F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most))), lambda n: F.array_join(F.slice(labels, -n, n), ".")
    ))


def path_folders(path: Column, most: Column | int) -> Column:
    """The empty prefix and those that end in a slash, ``most`` slashes at the longest."""
    return let(F.split(path, "/", -1), lambda parts: F.transform(
        F.sequence(F.lit(0), F.least(F.size(parts) - 1, F.lit(most))),
        lambda n: F.when(n == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/"))),
    ))


def digest_of(host: Column, folder: Column) -> Column:
    """SHA-256 of an expression; the length of the host keeps its two parts apart."""
    return F.sha2(F.concat(F.length(host).cast("string"), F.lit(":"), host, folder), 256)


def keyed_rules(rules: DataFrame) -> DataFrame:
    """One row per distinct host and path of the rules with its digest; of two verdicts ``block`` wins."""
    said = F.max(F.col("verdict") == "block")
    rows = rules.where((F.col("host") != "") & F.col("path").isNotNull() & F.col("verdict").isNotNull())
    rows = rows.select(lower_ascii(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
    rows = rows.groupBy("rule_host", "rule_path").agg(F.when(said, "block").otherwise("allow").alias("said"))
    rows = rows.withColumn("rule_digest", digest_of(F.col("rule_host"), folder_of(F.col("rule_path"))))
    return rows.withColumn("prefix", F.substring("rule_digest", 1, PREFIX_DIGITS))


def rule_hits(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``url, rule, said``: the winning rule of every url in ``urls`` (distinct, column ``url``) that has one."""
    keyed = keyed_rules(rules)
    size = keyed.agg(
        F.max(F.size(F.split("rule_host", r"\.", -1))).alias("labels"), F.max(F.size(F.split("rule_path", "/", -1)) - 1).alias("folders"),
        F.sum(F.length("rule_host") + F.length("rule_path") + 100).alias("bytes"),
    ).first()
    # No rule has more labels or slashes, so longer expressions of a url fit none.
    labels, folders = size["labels"] or 0, size["folders"] or 0
    rows = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not labels:
        return rows.select("url", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("said")).limit(0)
    parts = rows.select("url", "host", "path", F.explode(host_suffixes(F.col("host"), labels)).alias("suffix"))
    parts = parts.select("url", "path", "suffix", F.explode(path_folders(F.col("path"), folders)).alias("folder"))
    parts = parts.select("url", "path", digest_of(F.col("suffix"), F.col("folder")).alias("digest"))
    parts = parts.withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
    if size["bytes"] <= BROADCAST_BYTES:
        met = parts.join(F.broadcast(keyed), "prefix")
    else:
        salted = keyed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = parts.withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("int")).join(salted, ["prefix", "salt"])
    met = met.where((F.col("digest") == F.col("rule_digest")) & F.startswith("path", "rule_path"))
    order = F.struct((F.length("rule_host") + F.length("rule_path")).alias("length"), F.length("rule_host").alias("host_length"))
    won = F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "said"), order)
    return met.groupBy("url").agg(won.alias("won")).select("url", "won.rule", "won.said")


def judge_urls(pages: DataFrame, rules: DataFrame, *, url: str = "url", otherwise: str = "allow", host: str = "host", path: str = "path", rule: str = "rule", verdict: str = "verdict") -> DataFrame:
    """Add ``host, path, rule, verdict`` to every row: the longest rule that fits its url, and what it says.

    ``rules`` has ``host, path, verdict`` (``allow`` or ``block``). A rule fits its host and all subdomains
    of it where the path starts with its own; longest is by characters of both, then of the host. Every url
    is expanded into suffixes of its host and folders of its path, and hashed; expressions and rules meet
    on short prefixes of the hashes, whole digests confirm, and the rest of a rule's path is compared.
    Urls are judged once each, however many rows have them.

    No rule: ``rule`` is null and the verdict is ``otherwise``. A null url and one without ``://`` have an
    empty host and path, which no rule fits. Of a rule repeated with both verdicts ``block`` counts; rules
    with a null or an empty host are left out; an empty rule list or table is fine. Very long urls are read
    whole, but expanded no further than the rules have labels and slashes. Repeated rows stay. All other
    columns stay; columns with the names of the results are replaced.
    """
    results = (host, path, rule, verdict)
    kept = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("page"), F.col(url).alias("url"))
    # A url that holds no host meets no rule; as a key it would only bring such rows together.
    kept = kept.withColumn("key", F.when(F.contains("url", F.lit("://")), F.col("url")))
    hits = rule_hits(kept.select(F.col("key").alias("url")).where("key is not null").distinct(), rules)
    met = kept.join(hits.withColumnRenamed("url", "key"), "key", "left")
    added = {host: host_of(F.col("url")), path: path_of(F.col("url")), rule: F.col("rule"), verdict: F.coalesce("said", F.lit(otherwise))}
    others = [F.col(f"page.`{c}`").alias(c) for c in pages.columns if c not in results]
    return met.select(*others, *[value.alias(name) for name, value in added.items()])
