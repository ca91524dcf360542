"""Every query against SQL, on the given tables and on odd ones, and on empty tables."""

from __future__ import annotations

import pytest
from check_queries import TABLES, compare
from conftest import SF
from odd_tables import empty_dir, null_dir, odd_dir  # noqa: F401

from tarnscope.llm import queries, substrings
from tarnscope.llm.checks import SQL

RUN = queries.load_queries()


@pytest.fixture(scope="session")
def odd_duck(odd_dir):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings", "conversations", "pages"):
        con.execute(f"create view {table} as select * from '{odd_dir}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_given_tables(spark, duck, name):
    assert "documents" in TABLES
    assert compare(spark, duck, SF, name, RUN[name], SQL[name])[2] is None


# Repeated ids make the SQL of these join rows to each other; they are tested by hand below.
@pytest.mark.parametrize("name", sorted(set(SQL) - {"op4_winnowing_decontamination", "op8_prefix_suffix_trees", "op9_multi_index_near_dedup", "op13_importance_median_of_medians"}))
def test_odd_tables(spark, odd_duck, odd_dir, name):
    assert compare(spark, odd_duck, odd_dir, name, RUN[name], SQL[name])[2] is None


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("name", ["op4_winnowing_decontamination", "op8_prefix_suffix_trees", "op9_multi_index_near_dedup"])
def test_odd_documents(spark, odd_dir, name, hot, monkeypatch):
    import duckdb

    if hot and not name.startswith("op8"):
        pytest.skip("only one operator partitions hot anchors apart")
    if hot:
        monkeypatch.setattr(substrings, "HOT_TEXTS", 3)
        monkeypatch.setattr(substrings, "GROUP", 50)
    con = duckdb.connect()
    con.execute(f"create view benchmark as select * from '{odd_dir}/benchmark.parquet'")
    con.execute(f"create view documents as select * from (select distinct on (doc_id) * from '{odd_dir}/documents.parquet' order by doc_id)")
    want = {r[0]: r for r in con.execute(f"select * from ({SQL[name]})").fetchall()}
    names = [d[0] for d in con.description]
    got = RUN[name](spark, odd_dir)
    rows = [tuple(r[c] for c in names) for r in got.collect()]
    n = spark.read.parquet(f"{odd_dir}/documents.parquet").count()
    assert len(rows) == n
    for row in rows:
        assert row == want[row[0]]
    ids = [r[0] for r in rows]
    assert ids.count(11) == 3 and ids.count(7) == 2


@pytest.mark.parametrize("name", sorted(RUN))
def test_empty_tables(spark, empty_dir, name):
    assert RUN[name](spark, empty_dir).count() == (1 if name.startswith("op5") else 0)


@pytest.mark.parametrize("name", sorted(n for n in RUN if n.split("_")[0] not in ("op2", "op3", "op5", "op11", "op12")))
def test_documents_without_ids(spark, null_dir, name):
    rows = RUN[name](spark, null_dir).collect()
    assert len(rows) == spark.read.parquet(f"{null_dir}/documents.parquet").count()
    nameless = [r for r in rows if r["doc_id"] is None]
    assert nameless
    if name.startswith("op8"):
        assert all(r["n_removed"] == 0 for r in nameless)
    if name.startswith("op9"):
        assert all(r["kept"] and r["component_id"] is None for r in nameless)


def test_all_are_registered():
    import __spark_entry__ as entry

    assert {n.split("_")[0] for n in entry.queries() if n in RUN} == {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in entry.queries()
