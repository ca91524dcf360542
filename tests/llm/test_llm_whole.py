"""Inputs on which an operator that does less than the whole job gives other results."""

from __future__ import annotations

import random

import corpus_pipeline
import numpy as np
import pytest
from odd_tables import sentence, write_all

from tarnscope.llm import html_text, near_dedup, neighbours
from tarnscope.llm.common import load


def plain_links(rows: list[tuple[int, list[float]]]) -> dict[int, tuple[int, int]]:
    """Number of links and component of every vector, by brute force."""
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = (x @ x.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    label = ids.copy()
    while True:
        step = np.minimum(label, np.where(near, label[None, :], ids.max()).min(axis=1))
        if (step == label).all():
            return {int(i): (int(n), int(c)) for i, n, c in zip(ids, near.sum(axis=1), label, strict=True)}
        label = step


def two_groups(size: int, dim: int = 32) -> list[tuple[int, list[float]]]:
    """Near-copies of two vectors with a cosine of 0.96, and one vector apart."""
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.standard_normal((dim, 3)))
    centers = (q[:, 0], 0.97 * q[:, 0] + np.sqrt(1 - 0.97**2) * q[:, 1])
    vectors = [c + rng.standard_normal(dim) * 0.06 / np.sqrt(dim) for _ in range(size) for c in centers] + [q[:, 2]]
    return [(i, v.tolist()) for i, v in enumerate(vectors)]


def got_links(spark, rows) -> dict[int, tuple[int, int]]:
    out = neighbours.link_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert all(r["kept"] == (r["component_id"] == r["vec_id"]) for r in out)
    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out}


def test_op3_links_between_groups_with_full_lists(spark):
    rows = two_groups(40)
    want = plain_links(rows)
    assert len({c for _, c in want.values()}) == 2 and max(n for n, _ in want.values()) > 45
    assert got_links(spark, rows) == want


def test_op3_is_exact_if_the_audit_has_not_passed(spark, monkeypatch):
    rng = np.random.default_rng(6)
    one = rng.standard_normal((150, 32))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([one, one + 0.2 * rng.standard_normal(one.shape)]))]
    want = plain_links(rows)
    assert sum(n for n, _ in want.values()) > 200
    monkeypatch.setattr(neighbours, "LEAF", 0.001)
    monkeypatch.setattr(neighbours, "ROUNDS", 1)
    assert got_links(spark, rows) == want


def near_texts() -> list[tuple]:
    """Groups of 200-word texts with one to eight scattered words changed, similarity 0.67 to 0.95."""
    rng = random.Random(12)
    rows = []
    for group in range(30):
        words = sentence(rng, 200).split()
        rows.append((2 * len(rows), " ".join(words), None, "src"))
        for n in (3, 4, 4, 5, 8) if group % 2 else (4, 6):
            places = rng.sample(range(8, 192, 9), n)
            rows.append((2 * len(rows) + 1, " ".join(f"new{i}" if i in places else w for i, w in enumerate(words)), None, "src"))
    return rows


def plain_survivors(rows: list[tuple], least: float) -> set[int]:
    """Smallest id of every group of texts linked by 5-word shingles, by brute force."""
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.lower().split() for _, t, *_ in rows)]
    label = [r[0] for r in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])]
    for _ in rows:
        for i, j in near:
            label[i] = label[j] = min(label[i], label[j])
    return {r[0] for r, c in zip(rows, label, strict=True) if r[0] == c}


def test_pipeline_drops_near_copies_from_80_percent_on(spark, tmp_path):
    rows = near_texts()
    want = plain_survivors(rows, 0.8)
    assert 30 < len(want) < len(plain_survivors(rows, 0.85)) - 20
    sf_dir = write_all(tmp_path, rows)
    docs = load(spark, sf_dir, "documents")
    assert {r["doc_id"] for r in corpus_pipeline.minhash_near_dedup(spark, docs, sf_dir).collect()} == want
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in out} == want and len(out) == len(want) and all(r["round_trip"] for r in out)


@pytest.mark.parametrize("percent", [60, 80, 85, 90])
def test_chunks_miss_no_more_pairs_at_other_thresholds(percent):
    n = near_dedup.chunks_for(percent)
    assert near_dedup.chunk_miss(percent) ** n <= near_dedup.chunk_miss(85) ** 8


@pytest.mark.parametrize("html, lines", [
    ("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be</p>", "Let x=2 be"),
    ("<p>a</p><noscript><p>b</p></noscript><object data='x'>c</object><p>d</p>", "a\nb\nc\nd"),
    ("<p>a <svg><path d='x'/><text>b</text></svg> c</p><template>d</template><iframe>e</iframe>", "a b c\nd\ne"),
    ("<p>a</p><svg><g><p>b</p><div>c</div>", "a\nb\nc"),
    ("<p>a</p><noscript><img src=x><p>b</p>", "a\nb"),
    ("<p>a</p><textarea><p>b</p>", "a\nb"),
    ("<script>if(a<b){}</script><p>c</p>", "c"),
])
def test_op2_keeps_all_but_scripts_and_styles(html, lines):
    nodes, texts = html_text.parse(html)
    assert html_text.blocks(texts, np.ones(len(nodes), bool)) == lines


@pytest.mark.parametrize("percent", [80, 85])
def test_sketches_rule_out_no_link(spark, percent):
    import pyarrow as pa
    from pyspark.sql import functions as F

    rng = np.random.default_rng(8)
    sets = []
    for size in (1, 3, 40, 300, 5_000):
        base = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        for change in (0.0, 0.05, 0.1, 0.12, 0.2, 0.4):
            n = int(size * change)
            sets.append(np.unique(np.concatenate([base[n:], rng.integers(0, 1 << 63, n, dtype=np.uint64)])))
    batch = pa.record_batch({"node": pa.array(range(len(sets)), pa.int64()), "shingles": pa.array([s.tobytes() for s in sets], pa.binary())})
    sketches = pa.Table.from_batches(near_dedup._sketches(iter([batch]))).to_pylist()
    rows = spark.createDataFrame([(r["node"], len(sets[r["node"]]), 0, r["sketch"]) for r in sketches], "node long, n long, alone long, sketch array<long>")
    x, y = rows.alias("x"), rows.alias("y")
    able = {tuple(r) for r in x.join(y, (F.col("x.node") < F.col("y.node")) & near_dedup.can_link("x", "y", percent)).select("x.node", "y.node").collect()}
    linked = set()
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                linked.add((i, j))
    assert linked <= able and len(linked) > 20 and len(able) < 2 * len(linked)
