"""Conversation repair, URL rules and importance draws against plain versions."""

from __future__ import annotations

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter

import pytest
from odd_tables import odd_dir  # noqa: F401

from tarnscope.llm import chat_repair, importance, queries, url_filters
from tarnscope.llm.common import load

GRAMMAR = re.compile("(s?(ua)+)?")


def plain_audit(signature: str) -> tuple[int, str]:
    """Cheapest edits by search over places and roles so far, least string first among equal costs."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, at, roles = heapq.heappop(heap)
        if at == len(signature) and GRAMMAR.fullmatch(roles):
            return cost, audit
        # The last role and whether any stands are all that the grammar asks for.
        if (at, roles[-1:]) in seen:
            continue
        seen.add((at, roles[-1:]))
        legal = lambda r: bool(GRAMMAR.fullmatch(roles + r) or GRAMMAR.fullmatch(roles + r + "a") or GRAMMAR.fullmatch(roles + r + "ua"))  # noqa: B023, E731
        for r in "ua":
            if legal(r):
                heapq.heappush(heap, (cost + 5, audit + "I", at, roles + r))
        if at < len(signature):
            symbol, extra = signature[at], 5 if signature[at].isupper() else 0
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, roles))
            if symbol != "-":
                for r in "ua":
                    if legal(r):
                        heapq.heappush(heap, (cost + 1 + extra, audit + "R", at + 1, roles + r))
                if symbol.lower() in "sua" and legal(symbol.lower()):
                    heapq.heappush(heap, (cost + extra, audit + "K", at + 1, roles + symbol.lower()))
    raise AssertionError


def test_audits_are_the_cheapest_and_least(spark):
    rng = random.Random(5)
    given = {"".join(rng.choice("suuaaUAXSx-") for _ in range(rng.randrange(9))) for _ in range(400)} | {"", "ua" * 300, "s" + "ua" * 300 + "a"}
    rows = spark.createDataFrame([(s[::-1],) for s in given], "reversed string").repartition(5)
    got = {r["reversed"][::-1]: (r["cost"], r["audit"]) for r in chat_repair.best_audits(rows).collect()}
    assert set(got) == given
    for s in given:
        if len(s) < 9:
            assert got[s] == plain_audit(s), s
    assert got["ua" * 300] == (0, "K" * 600) and got["s" + "ua" * 300 + "a"] == (2, "K" * 600 + "DK")


def test_signatures_share_the_nodes_of_their_ends():
    import pyarrow as pa

    chat_repair.node_before.cache_clear()
    made = []
    plain = chat_repair.node_before

    def counted(*args):
        made.append(args[0])
        return plain(*args)

    try:
        chat_repair.node_before = counted
        words = sorted(s[::-1] for s in ("suaua", "uaua", "aua", "xaua", "ua"))
        list(chat_repair._audits(iter([pa.record_batch({"reversed": words})])))
    finally:
        chat_repair.node_before = plain
    assert len(made) == len("auaus") + len("x")


def test_repaired_turns_and_digests_agree(spark):
    turns = [
        (1, 0, "user", "Hi."), (1, 1, "user", "again"), (1, 2, "assistant", "Yes!"), (1, 3, "assistant", " \n"), (1, 3, "assistant", "Yes!"),
        (2, None, "system", "Rules."), (2, 5, "user", "A?"), (2, 5, "tool", "B."), (3, 1, None, None), (None, 1, "user", "é🙂."), (4, 0, "", "no role."),
        (5, 0, "user", "there is no answer."),
    ]
    frame = spark.createDataFrame([(*t, True) for t in turns] + [(9, 1, "user", "not there", False)], "conv_id long, turn long, role string, text string, there boolean")
    rows = {r["conv_id"]: r for r in chat_repair.repair_conversations(frame, present="there").collect()}
    said: dict = {}
    for r in chat_repair.repaired_turns(frame, present="there").orderBy("place").collect():
        said.setdefault(r["conv_id"], []).append((r["edit"], r["role"], r["text"]))
    assert set(rows) == {1, 2, 3, 4, 5, 9, None}
    assert [rows[1][k] for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")] == [0, 1, 1, 1, 3, 6, "KDKDD"]
    assert said[1] == [("K", "user", "Hi."), ("K", "assistant", "Yes!")]
    assert rows[2]["audit"] == "KRR" or rows[2]["audit"] == "KRK"  # by the digests of the two texts of turn 5
    assert rows[3]["blank"] == 1 and rows[3]["audit"] == "D" and 3 not in said
    assert rows[4]["audit"] == "D" and rows[5]["audit"] == "D" and rows[None]["audit"] == "D"
    assert rows[9]["cost"] == 0 and rows[9]["audit"] == "" and rows[9]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
    for conv, row in rows.items():
        text = "\n".join(f"{role}:{t}" for _, role, t in said.get(conv, []))
        assert row["repaired_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert GRAMMAR.fullmatch("".join(role[0] for _, role, _ in said.get(conv, [])))


def test_insertions_and_long_conversations(spark):
    cut = [(1, 0, "user", "no end"), (1, 1, "user", "B."), (1, 2, "user", "C.")]
    long = [(2, i, "ua"[i % 2], f"{i}.") for i in range(9_000)] + [(2, 9_001, "u", "9.")]
    got = {r["conv_id"]: r for r in chat_repair.repair_conversations(spark.createDataFrame(cut + long, "conv_id long, turn long, role string, text string")).collect()}
    assert (got[1]["cost"], got[1]["audit"]) == (3, "DKR")
    assert (got[2]["gaps"], got[2]["illegal"], got[2]["duplicate"], got[2]["cost"]) == (1, 0, 0, 2) and got[2]["audit"].count("K") == 9_000
    assert chat_repair.node_before("u", chat_repair.END[0], chat_repair.END[1])[0][0] == 2


def plain_rule(url, rules):
    at = (url or "").find("://")
    rest = url[at + 3 :] if url is not None and at >= 0 else ""
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[3:] if fits else (None, "allow")))


@pytest.mark.parametrize("broadcast", [True, False])
def test_rules_by_brute_force(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(url_filters, "BROADCAST_BYTES", 0)
    rng = random.Random(8)
    label, part = lambda: rng.choice(["a", "b", "net", "É", "x-1", ""]), lambda: rng.choice(["en", "e", "", "de%20", "f\nr"])
    rules = [(".".join(label() for _ in range(rng.randrange(1, 4))), rng.choice(["", "/"]) + "/".join(part() for _ in range(rng.randrange(4))), rng.choice(["allow", "block"])) for _ in range(150)]
    rules = [(h.replace("É", "é"), p if p[:1] in ("", "/") else "/" + p, v) for h, p, v in rules] + [("b", "/", "allow"), ("b", "/", "block")]
    urls = [rng.choice(["http://", "://", "x:///", "http:/", ""]) + ".".join(label().upper() if rng.random() < 0.3 else label() for _ in range(rng.randrange(6))) + rng.choice(["", "/", "/"]) + "/".join(part() for _ in range(rng.randrange(5))) + rng.choice(["", "?q=/://", "#a.b"]) for _ in range(1_500)]
    urls += [None, "", "://", "http://net", "http://net?x://b/", "a://B/é?", urls[0], urls[0], "http://" + "a." * 500 + "net/" + "e/" * 500]
    frame = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    out = url_filters.judge_urls(frame, spark.createDataFrame([*rules, (None, "/", "block"), ("a", None, "block"), ("a", "/", None)], "host string, path string, verdict string"))
    assert out.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    got = {r["page_id"]: tuple(r)[2:] for r in out.collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        want = plain_rule(u, rules)
        assert got[i] == want, (u, got[i], want)
    assert sum(g[2] is not None for g in got.values()) > 200


def test_no_rules(spark):
    out = url_filters.judge_urls(spark.createDataFrame([(1, "http://a/b")], "page_id long, url string"), spark.createDataFrame([], "host string, path string, verdict string"), otherwise="block").collect()
    assert [tuple(r) for r in out] == [(1, "http://a/b", "a", "/b", None, "block")]


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_features(text):
    w = plain_words(text)
    return [zlib.crc32(f.encode()) % 10_000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]


def test_draw_by_brute_force(spark, odd_dir):
    docs = [(r["doc_id"], r["text"]) for r in load(spark, odd_dir, "documents").collect()]
    source = Counter(b for _, t in docs for b in plain_features(t))
    target = Counter(b for r in load(spark, odd_dir, "benchmark").collect() for b in plain_features(r["text"]))
    big, small = sum(source.values()), sum(target.values())
    want = []
    for i, text in docs:
        found = plain_features(text)
        gain = [math.floor(1000 * math.log((target[b] + 1) * (big + 10_000) / ((source[b] + 1) * (small + 10_000)))) for b in found]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        want.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(plain_words(text))))
    got = [tuple(r) for r in queries.load_queries()["op13_importance_median_of_medians"](spark, odd_dir).collect()]
    assert sorted(g[:4] for g in got) == sorted(w[:4] for w in want)
    able = sorted((-score, i) for i, _, _, score, n in want if n >= 20)
    drawn = sorted(g for g in got if g[4] is not None)
    assert sorted((g[4], -g[3], g[0]) for g in drawn) == [(k + 1, *key) for k, key in enumerate(able[: 25 * len(able) // 100])]


@pytest.mark.parametrize("n, parts", [(1, 1), (2, 1), (2, 2), (7, 3), (500, 1), (500, 7), (500, 60)])
def test_cutoff_is_exact(spark, n, parts):
    rng = random.Random(n)
    keys = [(rng.randrange(3), rng.choice([1, 2, importance.LAST]), rng.randrange(-2, 2), i) for i in range(n)]
    frame = spark.createDataFrame(keys, "low long, id long, text_hash long, row long").repartition(parts)
    for k in {1, (n + 1) // 2, n}:
        assert importance.cutoff_key(frame, k) == sorted(keys)[k - 1]
