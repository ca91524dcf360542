"""Refusals and odd cases of claims, collation, canonical JSON, mask reuse and ring validity."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from tarnscope.functions.canonical import canonical_json, json_digest
from tarnscope.operators import claims as cl
from tarnscope.operators import collation as co
from tarnscope.operators import overlay as ov
from tarnscope.operators import store

CHECKS = "check string, claim string, verdict string, approved int"


def test_checks_must_be_well_formed(spark):
    rows = [("chk-a", "a", "confirmed", 1), ("chk-x", "b", "confirmed", 1), ("chk-c", "c", "perhaps", 1), ("chk-d", "d", "corrected", None), ("chk-e", "e", "not_verifiable", None), ("chk-f", "f", "confirmed", 1), ("chk-f", "f", "confirmed", 1), ("chk-g", "g", None, 1)]
    checks = cl.indexed_checks(spark.createDataFrame(rows, CHECKS))
    assert {r["claim"]: r["fault"] for r in checks.collect()} == {
        "a": None, "b": "check does not name its claim", "c": "unknown verdict", "d": "no approved values", "e": None, "f": "checked twice", "g": "unknown verdict",
    }
    assert cl.require_checks(checks.where("claim IN ('a', 'e')")).count() == 2
    with pytest.raises(Exception, match="checked twice: f"):
        cl.require_checks(checks.where("claim = 'f'")).collect()


def test_an_unknown_source_is_an_error(spark):
    refs = spark.createDataFrame([("e", "a"), ("a", "b"), ("b", "s1"), ("a", "s2"), ("x", "s9")], "claim string, cites string")
    claims = spark.createDataFrame([("a",), ("b",), ("e",), ("x",)], "claim string")
    closure = cl.cited_closure(refs, claims.where("claim IN ('e', 'b')"))
    assert {tuple(r) for r in closure.collect()} == {("e", "a", 1), ("e", "b", 2), ("e", "s2", 2), ("e", "s1", 3), ("b", "s1", 1)}
    known = spark.createDataFrame([("s1",), ("s2",)], "source string")
    assert cl.require_known_sources(closure, claims, known).count() == 5
    with pytest.raises(Exception, match="unknown source s2 of e"):
        cl.require_known_sources(closure, claims, known.where("source = 's1'")).collect()


def test_files_without_their_pair_bind_nothing(spark):
    files = spark.createDataFrame([("p/a-research.json",), ("p/a-checks.json",), ("p/b-research.json",), ("p/a-2-research.json",), ("p/a-2-checks.json",)], "path string")
    assert sorted(r["stem"] for r in cl.file_pairs(files, "path").collect()) == ["p/a", "p/a-2"]


def test_an_asset_that_failed_stays_expected(spark):
    tiles = spark.createDataFrame([("t", "m1"), ("t", "m2"), ("u", "m3")], "tile string, member string")
    assets = spark.createDataFrame([("t", "red", 10)], "tile string, band string, resolution int")
    got = {(r["tile"], r["member"], r["band"], r["resolution"], r["resolved"]) for r in co.expected_bands(tiles, tiles, assets, ["red", "nir"]).collect()}
    assert len(got) == 6 and ("t", "m1", "red", 10, True) in got and ("u", "m3", "red", None, False) in got and ("t", "m2", "nir", None, False) in got


def test_no_reader_is_right_if_signatures_differ(spark):
    names = spark.createDataFrame([(c,) for c in "abcde"], "configuration string")
    attempts = spark.createDataFrame([("a", True), ("b", True), ("c", True), ("d", False)], "configuration string, ended boolean")
    results = spark.createDataFrame([("a", 5, 5, "s"), ("b", 5, 5, "s"), ("c", 4, 5, "s"), ("d", 5, 5, "s")], "configuration string, rows int, expected int, signature string")
    told = lambda r: {x["configuration"]: (x["status"], x["matches_all"]) for x in co.configuration_status(names, attempts, r).collect()}
    assert told(results) == {"a": ("complete", True), "b": ("complete", True), "c": ("incomplete", None), "d": ("incomplete", None), "e": ("not_attempted", None)}
    other = results.withColumn("signature", F.when(F.col("configuration") == "b", "t").otherwise(F.col("signature")))
    assert told(other)["a"] == ("differs", False) and told(other)["b"] == ("differs", False)


def shuffled(value, rng):
    if isinstance(value, dict):
        return {k: shuffled(v, rng) for k, v in rng.sample(list(value.items()), len(value))}
    return [shuffled(v, rng) for v in value] if isinstance(value, list) else value


def grown(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        return rng.choice([None, True, False, 0, 7, -3, 2.5, 1e-4, "x", "1", 'q"\\/', "é\n", ""])
    if rng.random() < 0.5:
        return [grown(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["a", "b", "c-1", "d 2", 'e"', "f\\"]) + str(i): grown(rng, depth - 1) for i in range(rng.randrange(4))}


def test_json_digests_see_values_not_their_form(spark):
    rng = random.Random(6)
    values = [grown(rng, 6) for _ in range(60)]
    rows = [(i, json.dumps(v), json.dumps(shuffled(v, rng), indent=2, ensure_ascii=False), json.dumps([v, 0])) for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "i int, a string, b string, c string")
    got = frame.select("i", canonical_json(F.col("a")).alias("text"), (json_digest(F.col("a")) == json_digest(F.col("b"))).alias("same"), (json_digest(F.col("a")) != json_digest(F.col("c"))).alias("other")).collect()
    assert all(r["same"] and r["other"] for r in got)
    for r in got:
        assert json.loads(r["text"]) == values[r["i"]]
        assert r["text"] not in {x["text"] for x in got if values[x["i"]] != values[r["i"]]}
    numbers = ["1", "1.0", "10e-1", "-0.0", "0", "1e40", "10e39", "0.1", "1e-1", "123456789012345678901234567890", "1e-30"]
    texts = [r[0] for r in spark.createDataFrame([(n,) for n in numbers], "t string").select(canonical_json(F.col("t"))).collect()]
    assert texts[0] == texts[1] == texts[2] == "1" and texts[3] == texts[4] == "0" and texts[5] == texts[6] and texts[7] == texts[8] and texts[9] == numbers[9] and texts[10] != "0"


RINGS = "body long, part int, ring int, pts array<struct<x:double,y:double>>"


def square(x, y, size):
    return [(x, y), (x + size, y), (x + size, y + size), (x, y + size), (x, y)]


def test_prepared_masks_are_computed_once(spark, tmp_path):
    shapes = spark.createDataFrame([(1, 0, 0, square(20.0, -80.0, 35.0)), (2, 0, 0, square(50.0, -60.0, 20.0)), (3, 0, 0, square(20.0, -80.0, 35.0)), (4, 0, 0, square(9000.0, 0.0, 20.0))], RINGS)
    rings = shapes.withColumns({"resolution": F.lit(10.0), "x0": F.lit(0.0), "y0": F.lit(0.0), "rows": F.lit(12), "cols": F.lit(12)})
    run = lambda r, **more: store.prepare_masks(r, ["body"], str(tmp_path), resolution=10.0, **more)
    told = lambda d: {r["body"]: r["reused"] for r in d.collect()}
    pixels, first = run(rings)
    assert told(first) == {1: False, 2: False, 3: False, 4: False}
    rows = sorted(tuple(r) for r in pixels.collect())
    assert {r[0] for r in rows} == {1, 2, 3} and len({r[1] for r in rows if r[0] in (1, 3)}) == 1
    stored = lambda: sorted(str(p) for part in ("pixels", "index") for p in (tmp_path / part).rglob("part-*"))
    files = stored()
    again, second = run(rings)
    assert told(second) == dict.fromkeys((1, 2, 3, 4), True) and sorted(tuple(r) for r in again.collect()) == rows
    assert stored() == files
    moved = rings.withColumn("pts", F.when(F.col("body") == 2, F.transform("pts", lambda p: F.struct((p.x + 1).alias("x"), p.y.alias("y")))).otherwise(F.col("pts")))
    _, third = run(moved)
    assert told(third) == {1: True, 2: False, 3: True, 4: True}
    assert told(run(rings, near_m=50.0)[1])[1] is False


def test_a_crossed_ring_is_an_error(spark):
    bow, plain = [(0.0, 0.0), (10.0, 10.0), (10.0, 0.0), (0.0, 10.0), (0.0, 0.0)], square(0.0, 0.0, 10.0)
    touching = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 0.0), (0.0, 4.0), (0.0, 0.0)]
    rings = spark.createDataFrame([(1, 0, 0, bow), (2, 0, 0, plain), (2, 0, 1, square(2.0, 2.0, 3.0)), (3, 0, 0, touching)], RINGS)
    for cell in (1.0, 5.0, 100.0):
        edges = ov.boundary_edges(rings.where("body <> 1"), ["body"]).unionByName(ov.boundary_edges(rings.where("body = 1"), ["body"]))
        assert {r["body"]: r["crossings"] for r in ov.crossed_edges(edges, ["body"], cell).collect()} == {1: 1}
    assert ov.require_simple(rings.where("body <> 1"), ["body"], 5.0).count() == 3
    with pytest.raises(Exception, match="polygon crosses itself: 1"):
        ov.require_simple(rings, ["body"], 5.0).collect()
