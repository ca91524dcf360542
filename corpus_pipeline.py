"""Corpus preparation: five stages from raw documents to token ids.

Every stage takes and returns whole rows: a null or empty text is a document like any other, very long
texts are read whole, an empty table gives an empty table, columns beyond those of ``documents`` pass
through the stages before the last whatever their names, and equal rows are treated alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnscope.llm import decontaminate, language, near_dedup, pieces, secrets
from tarnscope.llm.common import free_name, load, packed, small_batches, unpacked, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; texts without a letter, null and empty ones among them, and
    doubtful ones go. The model is trained on the labels of the same documents; without any label
    nothing is decided and all stay. Equal texts, at equal scores too, get the same decision."""
    small_batches(spark)
    model = language.train_languages(docs)
    if model is None:
        return docs
    told = language.identify_languages(packed(docs, "text", "doc"), model)
    return told.where(language.accepted(F.col("lang_pred"), F.col("score"))).select(unpacked(docs.columns, "text", "doc"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near-duplicates, and all without any. Texts
    are linked from a similarity of 0.8 on. Rows of one id are told apart by their texts: each stays
    or goes with the group of its own text, and repeated rows stay or go together. Rows without an id
    and texts without words, null and empty ones among them, stay."""
    small_batches(spark)
    gone = near_dedup.near_duplicates(docs, percent=80).where(~F.col("kept"))
    names = [free_name(n, docs.columns) for n in ("gone_id", "gone_hash")]
    gone = gone.select(F.col("doc_id").alias(names[0]), F.col("text_hash").alias(names[1])).distinct()
    same = (F.col("doc_id") == F.col(names[0])) & (F.xxhash64("text") == F.col(names[1]))
    return docs.join(gone, same, "left_anti")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark text. Null and empty texts have no words
    and stay; rows of one id are judged by their own texts, repeated rows alike, rows without id too."""
    found = decontaminate.find_contamination(docs, load(spark, sf_dir, "benchmark"))
    gone = free_name("gone", docs.columns)
    found = found.where(decontaminate.is_contaminated(F.col("n_hit"), F.col("n_words"))).select(F.col("row_id").alias(gone)).distinct()
    return docs.join(found, decontaminate.row_id("doc_id", "text") == F.col(gone), "left_anti")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by a mark, ``n_chars`` following the new text. Null and
    empty texts stay as they are; spans that overlap are replaced as one."""
    found = secrets.scan_secrets(packed(docs, "text", "doc"))
    clean = found.select("doc", "text", secrets.redact(F.col("text"), F.col("spans")).alias("clean"))
    changed = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("text").eqNullSafe(F.col("clean")), F.col("doc.n_chars")).otherwise(F.length("clean"))
    return clean.select([changed[c].cast(docs.schema[c].dataType).alias(c) if c in changed else old for c, old in zip(docs.columns, unpacked(docs.columns, "text", "doc"), strict=True)])


def sentencepiece_codec(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, decoded again and compared. A null text has null ids and decodes to null,
    an empty one has none; repeated rows are coded one by one. Columns beyond the named ones end here."""
    small_batches(spark)
    both = pieces.decode_pieces(pieces.encode_pieces(docs.select("doc_id", "lang", "source", "text")))
    return both.select("doc_id", "lang", "source", "piece_ids", F.size("piece_ids").cast("long").alias("n_pieces"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


STAGES = [
    ("language_id", language_id),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("sentencepiece_codec", sentencepiece_codec),
]

# SQL has no counterpart of the language model and the piece search.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
