"""The pipeline and each of its stages on odd, null, empty and clashing tables."""

from __future__ import annotations

import corpus_pipeline
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from odd_tables import empty_dir, null_dir, odd_dir, sentence, write_all  # noqa: F401

from tarnscope.llm.common import load

CLASH = ("gone", "gone_id", "gone_hash", "doc", "clean", "text_hash", "lang_pred", "score", "row_id", "spans", "base", "found")


def folder(request, which: str) -> str:
    return request.getfixturevalue(f"{which}_dir")


@pytest.mark.parametrize("which", ["null", "empty"])
@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stages_return_the_columns_of_their_input(request, spark, which, name, stage):
    docs = load(spark, folder(request, which), "documents")
    docs = docs.select("*", *[docs.source.alias(c) for c in CLASH if c not in docs.columns])
    out = stage(spark, docs, folder(request, which))
    assert out.columns == docs.columns
    rows, given = out.collect(), {(r["doc_id"], r["text"]) for r in docs.collect()}
    assert len(rows) <= docs.count()
    if name != "secret_scan":
        assert {(r["doc_id"], r["text"]) for r in rows} <= given
    if name in ("minhash_near_dedup", "benchmark_decontamination", "secret_scan"):
        assert {i for i, t in given if not (t or "").strip()} <= {r["doc_id"] for r in rows}


@pytest.mark.parametrize("which", ["odd", "empty"])
def test_whole_pipeline(request, spark, which):
    rows = corpus_pipeline.run(spark, folder(request, which)).collect()
    assert bool(rows) == (which != "empty") and all(r["round_trip"] for r in rows)


def test_no_text_of_a_repeated_id_is_lost(spark, tmp_path):
    import random

    rng = random.Random(3)
    a, b = sentence(rng, 60), sentence(rng, 60)
    sf_dir = write_all(tmp_path, [(1, a, None, "s"), (2, a, None, "s"), (2, b, None, "s"), (2, b, None, "s"), (None, a, None, "s")])
    kept = corpus_pipeline.minhash_near_dedup(spark, load(spark, sf_dir, "documents"), sf_dir).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == sorted([("1", a), ("2", b), ("2", b), ("None", a)])


def test_secrets_are_replaced_and_sizes_follow(spark, tmp_path):
    text = "Before password = hunter2hunter after"
    write_all(tmp_path, [])
    pq.write_table(pa.table({"doc_id": pa.array([1, 2, 3], pa.int64()), "text": [text, "clean", None], "n_chars": pa.array([len(text), 5, None], pa.int64())}), tmp_path / "documents.parquet")
    rows = {r["doc_id"]: r for r in corpus_pipeline.secret_scan(spark, load(spark, str(tmp_path), "documents"), str(tmp_path)).collect()}
    assert rows[1]["text"] == "Before [SECRET] after" and rows[1]["n_chars"] == len(rows[1]["text"])
    assert (rows[2]["text"], rows[2]["n_chars"]) == ("clean", 5) and rows[3]["text"] is None
