"""Operators that SQL cannot express, against plain versions, round trips and held-out data."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF
from odd_tables import odd_dir  # noqa: F401

from tarnscope.llm import boosting, hidden_markov, html_text, language, pieces, queries, secrets
from tarnscope.llm.common import load

RUN = queries.load_queries()


def test_languages_are_told_apart_on_held_out_texts(spark):
    docs = load(spark, SF, "documents").select("doc_id", "lang").toPandas()
    got = RUN["op1_ftrl_language"](spark, SF).toPandas().merge(docs, on="doc_id")
    held = got[got.held_out]
    assert (held.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3) == 1).all()
    assert (held.lang_pred == held.lang).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_texts_without_letters_have_no_language(spark, odd_dir):
    texts = {r["doc_id"]: r["text"] for r in load(spark, odd_dir, "documents").collect()}
    for row in RUN["op1_ftrl_language"](spark, odd_dir).collect():
        none = not any(map(str.isalpha, texts[row["doc_id"]] or ""))
        assert (row["lang_pred"] == "und") == none


def test_temperature_lowers_the_loss_of_an_overconfident_model():
    logits = np.array([[9.0, 0.0]] * 10)
    labels = np.array([0] * 7 + [1] * 3)
    assert language.fit_temperature(logits, labels) == pytest.approx(9 / math.log(7 / 3), rel=0.01)


def test_sparse_weights():
    rng = np.random.default_rng(1)
    examples = [(np.array([int(rng.integers(5)), 7 + i % 2]), np.array([1.0, 1.0]), i % 2) for i in range(200)]
    weights, _ = language.fit_ftrl(examples, 2, l1=2.0)
    assert np.count_nonzero(weights.any(axis=1)) < 8 and weights[7, 0] > 0 > weights[7, 1]


def test_pages(spark):
    from html import unescape

    for row in RUN["op2_boosted_html_text"](spark, SF).join(load(spark, SF, "pages").select("page_id", "html"), "page_id").collect():
        article = row["html"].split("<article>")[1].split("</article>")[0]
        lines = (" ".join(unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", article))
        assert row["text"] == "\n".join(x for x in lines if x)
        assert row["n_chars"] == len(row["text"])


def test_odd_pages(spark, odd_dir):
    rows = RUN["op2_boosted_html_text"](spark, odd_dir).collect()
    assert sorted((r["page_id"], r["text"]) for r in rows)[:2] == [(0, ""), (1, "")]
    assert len({r["text"] for r in rows if r["page_id"] == 2}) == 1


@pytest.mark.parametrize("html, lines", [
    ("<ul><li>a<li>b</ul>", "a\nb"),
    ("<p>a <b>b<p>c</b> d", "a b\nc d"),
    ("x<script>var a='<p>no</p>'</script>y<style>p{}</style>", "xy"),
    ("<!-- <p>no</p> -->yes &lt;b&gt; &#233;", "yes <b> é"),
    ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"),
    ("<div>a<div>b</div>c</div>", "a\nb\nc"),
])
def test_blocks(html, lines):
    nodes, texts = html_text.parse(html)
    assert html_text.blocks(texts, np.ones(len(nodes), bool)) == lines


def test_new_layouts_and_consistent_choice(spark):
    pages = [r["html"] for r in load(spark, SF, "pages").limit(100).collect()]
    trees = html_text.train_extractor(pages, layouts=500)
    rng, wrong, n = np.random.default_rng(77), 0, 0
    for _ in range(100):
        nodes, _ = html_text.parse(html_text.made_page(rng, ["Some line of text, rather long, with two commas.", "Another one"]))
        kept = html_text.decode(nodes, trees.log_odds(html_text.features(nodes)))
        for i, x in enumerate(nodes[1:], 1):
            x.dropped |= nodes[x.parent].dropped
            assert not kept[i] or kept[x.parent]
        wrong += sum(k == x.dropped for k, x in zip(kept, nodes, strict=True))
        n += len(nodes)
    assert wrong < 0.03 * n


def test_trees_learn_an_interaction():
    x = np.random.default_rng(0).random((2000, 3))
    y = ((x[:, 0] > 0.5) != (x[:, 1] > 0.3)).astype(float)
    odds = boosting.fit_trees(x, y).log_odds(x)
    assert ((odds > 0) == y).mean() > 0.97


def tiny_model() -> hidden_markov.Model:
    rng = np.random.default_rng(2)
    norm = lambda a, axis: a / a.sum(axis=axis, keepdims=True)
    return hidden_markov.Model(norm(rng.random(3), 0), norm(rng.random((3, 3)), 1), norm(rng.random((5, 3)), 0))


def paths(model, seq):
    for path in itertools.product(range(3), repeat=len(seq)):
        p = model.start[path[0]] * model.emit[seq[0], path[0]]
        for t in range(1, len(seq)):
            p *= model.move[path[t - 1], path[t]] * model.emit[seq[t], path[t]]
        yield path, p


def test_likelihood_is_the_sum_over_all_state_paths():
    model = tiny_model()
    seqs = [np.array(s, np.uint16) for s in ([4], [0, 1, 4], [3, 3, 2, 1, 0, 4], [2, 4])]
    want = [math.log10(sum(p for _, p in paths(model, s))) for s in seqs]
    assert hidden_markov.log_likelihoods(model, seqs) == pytest.approx(want)


def test_expected_counts_are_those_of_all_state_paths():
    model = tiny_model()
    seqs = [np.array(s, np.uint16) for s in ([4], [0, 1, 4], [3, 3, 2, 1, 4])]
    starts, moves, emits = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for s in seqs:
        total = sum(p for _, p in paths(model, s))
        for path, p in paths(model, s):
            starts[path[0]] += p / total
            for a, b in itertools.pairwise(path):
                moves[a, b] += p / total
            for w, a in zip(s, path, strict=True):
                emits[w, a] += p / total
    got = hidden_markov.expected_counts(model, seqs)
    for mine, want in zip(got, (starts, moves, emits), strict=True):
        assert mine == pytest.approx(want, rel=1e-4)


@pytest.mark.parametrize("head", [50_000, 40])
def test_scores_of_texts(spark, odd_dir, head, monkeypatch):
    monkeypatch.setattr(hidden_markov, "HEAD", head)
    texts = {r["doc_id"]: (r["text"] or "") for r in load(spark, odd_dir, "documents").collect()}
    rows = load(spark, odd_dir, "documents").collect()
    tokens = {i: [*t.encode().lower().split(), None] for i, t in texts.items()}
    learn = Counter(w for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 10 for w in tokens[r["doc_id"]])
    n, v = sum(learn.values()), len(learn)
    for row in RUN["op6_hidden_markov_scores"](spark, odd_dir).collect():
        own = tokens[row["doc_id"]]
        assert row["n_tokens"] == len(own) and row["train_tokens"] == n
        assert row["n_known"] == sum(learn[w] > 0 for w in own)
        assert row["base_score"] == pytest.approx(sum(math.log10((learn[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own))
        assert row["score"] < 0


def test_where_emissions_lie_changes_no_score(spark, odd_dir, monkeypatch):
    monkeypatch.setattr(hidden_markov, "COMMON", 5)
    scores = []
    for head in (50_000, 40):
        monkeypatch.setattr(hidden_markov, "HEAD", head)
        scores.append(sorted((r["doc_id"], r["n_tokens"], r["score"]) for r in RUN["op6_hidden_markov_scores"](spark, odd_dir).collect()))
    for a, b in zip(*scores, strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-6)


def test_every_word_has_emissions_of_its_own(spark, monkeypatch):
    """Two kinds of texts over 600 words with 20 in the head: after training, most words prefer a state."""
    monkeypatch.setattr(hidden_markov, "HEAD", 20)
    rng = np.random.default_rng(5)
    words = [[f"{kind}{i}" for i in range(300)] for kind in "xy"]
    texts = [(i, " ".join(rng.choice(words[i % 2], 80))) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t in texts] + [(1_000, "x1 x2 x3 x4 x5 x6 x7 x8"), (1_001, "x1 y2 x3 y4 x5 y6 x7 y8")], "doc_id long, text string")
    from pyspark.sql import functions as F

    got = {r["doc_id"]: r for r in hidden_markov.score_texts(docs, held_out=F.col("doc_id") >= 1_000).collect()}
    assert got[1_000]["score"] > got[1_001]["score"] + 1 and got[1_000]["n_known"] == 9


def test_first_guess_of_the_states_counts_every_learning_text(spark, monkeypatch):
    from pyspark.sql import functions as F

    rounds, one_round = [], hidden_markov.cluster_round

    def watched(encoded, place, shares):
        rounds.append((place, *one_round(encoded, place, shares)))
        return rounds[-1][1:]

    monkeypatch.setattr(hidden_markov, "cluster_round", watched)
    docs = spark.range(5_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("both "), F.when(F.col("id") % 2 == 0, "even even").otherwise("odd"), F.lit(" all")).alias("text"))
    assert hidden_markov.score_texts(docs, held_out=F.col("doc_id") >= 4_000, iterations=1).count() == 5_000
    assert len(rounds) > 1
    for place, found, _ in rounds:
        # Head words by falling counts, then by their bytes: all, both, even, odd; then the end.
        assert found[place[[0, 1, 2, 3, 5]]].sum(axis=1) == pytest.approx([4_000, 4_000, 4_000, 2_000, 4_000])


def test_whole_texts_are_run_through(monkeypatch):
    """Expected counts of a text of 1,000 tokens beside short ones, by plain recursions without scaling."""
    rng = np.random.default_rng(9)
    model = tiny_model()
    texts = [rng.integers(0, 5, n).astype(np.uint16) for n in (1_000, 3, 1, 40)]
    monkeypatch.setattr(hidden_markov, "TOGETHER", 50)
    starts, moves, emits = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for x in texts:
        log = lambda a: np.log(a)
        forward = [log(model.start) + log(model.emit[x[0]])]
        for w in x[1:]:
            forward.append(np.logaddexp.reduce(forward[-1][:, None] + log(model.move), axis=0) + log(model.emit[w]))
        back = [np.zeros(3)]
        for w in x[:0:-1]:
            back.append(np.logaddexp.reduce(log(model.move) + log(model.emit[w])[None, :] + back[-1][None, :], axis=1))
        back = back[::-1]
        whole = np.logaddexp.reduce(forward[-1])
        for t, w in enumerate(x):
            own = np.exp(forward[t] + back[t] - whole)
            emits[w] += own
            starts += own if t == 0 else 0
            if t:
                moves += np.exp(forward[t - 1][:, None] + log(model.move) + (log(model.emit[w]) + back[t])[None, :] - whole)
    for mine, want in zip(hidden_markov.expected_counts(model, texts), (starts, moves, emits), strict=True):
        assert mine == pytest.approx(want, rel=1e-8)


def test_packs_of_texts_change_no_score(spark, odd_dir, monkeypatch):
    monkeypatch.setattr(hidden_markov, "HEAD", 40)
    monkeypatch.setattr(hidden_markov, "COMMON", 5)
    scores = []
    for pack in (1_000_000, 200):
        monkeypatch.setattr(hidden_markov, "PACK", pack)
        scores.append(sorted((r["doc_id"], r["n_known"], r["base_score"], r["score"]) for r in RUN["op6_hidden_markov_scores"](spark, odd_dir).collect()))
    for a, b in zip(*scores, strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2]) and a[3] == pytest.approx(b[3], rel=1e-5)


def test_iterations_leave_one_table_and_no_shuffles(spark, monkeypatch):
    """On disk after three iterations: the packs, what the last iteration wrote, and little else."""
    from pathlib import Path

    from pyspark.sql import functions as F

    from tarnscope.session import shared_folder

    monkeypatch.setattr(hidden_markov, "HEAD", 20)
    tables = lambda: {p.name for p in Path(shared_folder(spark).removeprefix("file:")).glob("tarnscope-*")}
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: sum(Path(f).stat().st_size for f in blocks.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f and Path(f).exists())
    docs = spark.range(2_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit("w"), F.col("id") * 7 + i) for i in range(20)]).alias("text"))
    before, files = tables(), shuffled()
    assert hidden_markov.score_texts(docs, held_out=F.col("doc_id") % 10 == 0).where("score < 0 AND n_tokens = 21").count() == 2_000
    assert sorted(name.split("-")[1] for name in tables() - before) == ["counts", "tokens"]
    assert shuffled() - files < 2_000_000


def test_model_is_better_than_single_words_on_held_out_texts(spark):
    got = RUN["op6_hidden_markov_scores"](spark, SF).toPandas()
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()


def test_pieces_round_trip_and_best_score(spark, odd_dir):
    rows = RUN["op7_aho_corasick_pieces"](spark, odd_dir).collect()
    texts = {r["doc_id"]: r["text"] for r in load(spark, odd_dir, "documents").collect()}
    for row in rows:
        text = texts[row["doc_id"]]
        assert row["round_trip"] and (row["decoded_sha256"] is None) == (text is None)
        if text is not None:
            assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def plain_best(codec, scores, text):
    best = [0.0] + [-1e300] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(end):
            if text[start:end] in scores:
                best[end] = max(best[end], best[start] + scores[text[start:end]])
        if text[end - 1] not in scores:
            best[end] = max(best[end], best[end - 1] + codec.unknown)
    return best[-1]


@pytest.mark.parametrize("text", ["Thatre ereninger the", "été où  naïve", "漢字 abc\n\nxyz", " lead", "a\n b", "tab\there  two ▁ blank", "x" * 40])
def test_pieces_have_the_best_score(text):
    vocabulary = pieces.read_pieces(pieces.MODEL)
    codec = pieces.Codec(vocabulary)
    scores = {p: s for p, s, kind in vocabulary if kind == "piece"}
    ids = np.frombuffer(codec.encode(text), np.int32)
    assert codec.decode(ids) == text
    got, spelt = 0.0, b""
    for i in ids.tolist():
        piece, score, kind = vocabulary[i]
        spelt = spelt + codec.surface[i] if kind == "byte" else b""
        got += score if kind == "piece" else 0.0
        if kind == "byte":
            try:
                spelt.decode()
                got, spelt = got + codec.unknown, b""
            except UnicodeDecodeError:
                pass
    marked = pieces.SPACE + text.replace(pieces.SPACE, "\x00").replace(" ", pieces.SPACE)
    assert got == pytest.approx(plain_best(codec, scores, marked))


def plain_base(text: str) -> list[tuple]:
    out = []
    letters = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out += [(m.start(), 0, m.end()) for m in letters.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


@pytest.mark.parametrize("folder", ["odd", "given"])
def test_base_spans(spark, odd_dir, folder):
    where = odd_dir if folder == "odd" else SF
    texts = {r["doc_id"]: r["text"] or "" for r in load(spark, where, "documents").collect()}
    found = 0
    for row in RUN["op10_markov_secrets"](spark, where).collect():
        base = plain_base(texts[row["doc_id"]])
        listed = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert row["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [row["n_assign"], row["n_access"], row["n_hex"]] == [sum(k == j for _, k, _ in base) for j in range(3)]
        assert set(filter(None, listed.split(","))) <= set(row["spans"].split(","))
        found += len(base)
    assert found or folder == "given"


def test_models_tell_random_strings_from_ordinary_ones(spark):
    from pyspark.sql import functions as F

    ordinary = [(False, w) for w in ("configuration_manager", "ConnectionFactory", "temperature", "request_handler", "international") * 20]
    random = [(True, hashlib.sha256(str(i).encode()).hexdigest()[:30] + "Qx7Zk2") for i in range(100)]
    table = secrets.train_markov(spark.createDataFrame(ordinary + random, "random boolean, value string"))
    rows = spark.createDataFrame([("handler_configuration",), ("9f8a7c6e5d4b3a2f1e0d9c8b",)], "value string")
    low, high = (r[0] for r in rows.select(secrets.likelihood_ratio(F.col("value"), F.lit(table))).collect())
    assert low < 0 < high


def test_redaction(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("🙂 key 123456 and 7890", [(0, 6, 12), (2, 8, 14), (1, 17, 21)]), ("clean", []), (None, [])], "text string, spans array<struct<kind:int,start:int,end:int>>")
    got = [r[0] for r in rows.select(secrets.redact(F.col("text"), F.col("spans"), "#")).collect()]
    assert got == ["🙂 key " + "#" + "nd " + "#", "clean", None]
