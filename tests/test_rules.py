"""Semantics on small cases, and refusals."""

from __future__ import annotations

import math
import os
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tarnscope.functions import names as nm
from tarnscope.functions import scalars as sc
from tarnscope.operators import costs, coverage, covers, extraction, latency, logs, pairing, pixels, quantiles
from tarnscope.operators import geometry as geo


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("v")).first().v


def refuses(spark, column):
    with pytest.raises(PySparkException):
        one(spark, column)


def test_month_status_in_order(spark):
    cases = [("r1", True, True, False), ("r2", True, False, True), ("r3", True, False, False)]
    rows = [("T", "2024-01", k, r, p, f) for k, r, p, f in cases] + [("T", "2024-02", "x", True, False, False), ("T", "2024-03", "y", True, True, False), ("T", "2024-04", "z", False, True, False)]
    df = spark.createDataFrame(rows, "tile string, month string, key string, r boolean, p boolean, f boolean")
    out = coverage.compare_archives(df, ["tile"], "month", "key", ("r", "p", "f"), F.lit("2024-01-03").cast("date"), F.lit("2024-05-09").cast("date"))
    got = {x.month: x for x in out.collect()}
    assert [got[f"2024-0{i}"].status for i in range(1, 6)] == ["partial", "empty", "complete", "primary_only", "no_reference"]
    assert (got["2024-01"].missing, got["2024-01"].covered_by_fallback, got["2024-01"].uncovered) == (2, 1, 1)


def test_acquisitions_are_counted_not_items(spark):
    df = spark.createDataFrame([("T", "2024-01", "a")] * 3 + [("T", "2024-01", "b")], "tile string, month string, key string")
    day = F.lit("2024-01-01").cast("date")
    row = coverage.monthly_summary(df, ["tile"], "month", "key", day, day).first()
    assert (row.items, row["acquisitions"], row.duplicate_acquisitions) == (4, 2, 1)


def test_spans_join_across_a_year_end(spark):
    df = spark.createDataFrame([("T", m) for m in ("2023-11", "2023-12", "2024-01", "2024-03")], "tile string, month string")
    got = sorted((r.first, r.last) for r in coverage.month_spans(df, ["tile"], "month").select(F.col("first").alias("first"), "last").collect())
    assert got == [("2023-11", "2024-01"), ("2024-03", "2024-03")]


def test_flags_decode_only_exact_multiples(spark):
    df = spark.createDataFrame([(v,) for v in (-32768, 0, 40000, 40001, -10000)], "v long")
    got = [tuple(r) for r in df.select(*[c.alias(n) for n, c in sc.decode_flags(F.col("v")).items()]).collect()]
    assert got == [(0, True, False), (0, False, False), (4, False, False), (0, False, True), (-1, False, False)]


def test_refusals(spark):
    refuses(spark, nm.l1c_name(F.lit("S2A_MSIL2A_x")))
    refuses(spark, nm.tile_prefix(F.lit("XX")))
    refuses(spark, nm.parse_month(F.lit("2024-13")))
    refuses(spark, sc.cloud_bin(F.lit(101.0)))
    refuses(spark, F.size(sc.month_list(F.lit("2024-02-01").cast("date"), F.lit("2024-01-01").cast("date"))))
    refuses(spark, sc.epoch_seconds(F.lit("2024-01-01T00:00:00")))
    refuses(spark, geo.grid_shape(F.lit(10981), F.lit(10980), F.lit(60))[1])
    assert one(spark, sc.epoch_seconds(F.lit(None).cast("string"), optional=True)) == -math.inf


def test_selection_of_the_wrong_length_is_refused(spark):
    df = spark.createDataFrame([("a", 2, [1], [1])], "lake string, n int, positions array<int>, classes array<int>")
    with pytest.raises(PySparkException):
        extraction.unpack_selection(df, ["lake"]).collect()


def test_duplicate_and_unexpected_contributions_are_refused(spark):
    want = spark.createDataFrame([("a",), ("b",)], "k string")
    have = spark.createDataFrame([("a", 3, None), ("a", 3, None), ("c", 1, None)], "k string, pixels int, error string")
    records = extraction.contributions(want, have, ["k"], "pixels", "error")
    assert {r.k: r.status for r in records.collect()} == {"a": "duplicate", "b": "missing", "c": "unexpected"}
    with pytest.raises(PySparkException):
        extraction.require_clean(records).collect()


def test_value_change_and_repeat_show_as_differences(spark):
    a = spark.createDataFrame([(1, 5), (2, 6)], "k int, v int")
    b = spark.createDataFrame([(1, 5), (2, 7), (1, 5)], "k int, v int")
    got = sorted((r.k, r.v, r.side, r.surplus) for r in extraction.row_differences(a, b, ["k", "v"]).collect())
    assert got == [(1, 5, "second", 1), (2, 6, "first", 1), (2, 7, "second", 1)]


def test_quantiles_with_a_hot_group(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.8 else f"g{rng.randrange(5)}", rng.choice([rng.gauss(0, 50), 7.0])) for _ in range(4000)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in quantiles.nearest_rank(df, ["g"], "v", {"p10": 0.1, "p50": 0.5, "p99": 0.99}, bucket=3.0).collect()}
    for g in {r[0] for r in rows}:
        values = sorted(v for k, v in rows if k == g)
        for name, q in (("p10", 0.1), ("p50", 0.5), ("p99", 0.99)):
            assert got[g][name] == values[max(1, math.ceil(q * len(values))) - 1]
        assert (got[g].n, got[g]["min"], got[g]["max"]) == (len(values), values[0], values[-1])


def test_linear_quantiles_and_null_groups(spark):
    df = spark.createDataFrame([(None, float(v)) for v in (1, 2, 3, 10)] + [("a", 5.0), ("a", None)], "g string, v double")
    got = {r.g: r.p25 for r in quantiles.linear(df, ["g"], "v", {"p25": 0.25}, bucket=2.0).collect()}
    assert got == {None: pytest.approx(1.75), "a": 5.0}


def test_half_even_histogram_and_quantile(spark):
    df = spark.createDataFrame([(v,) for v in (0.5, 1.5, 2.5, -9000.0)], "v double")
    hist = pixels.histogram(df.withColumn("k", F.lit(1)), ["k"], F.col("v"), -5000, 5000)
    assert {r.bin: r.n for r in hist.collect()} == {0: 1, 2: 2, -5000: 1}
    assert pixels.histogram_quantiles(hist, ["k"], {"p50": 0.5}).first().p50 == 0


def test_correlation_is_null_without_variance(spark):
    df = spark.createDataFrame([(1, 5), (1, 9)], "a int, s int")
    row = pixels.describe_pairs(df.agg(*pixels.paired_sums("a", "s"))).first()
    assert row.pearson_r is None and row.verdict == "agree"


def test_moments_of_large_close_values_do_not_cancel(spark):
    from fractions import Fraction

    rows = [(10**8 + i % 7, 10**8 + i % 7 + i % 3 / 4) for i in range(500)]
    row = pixels.describe_pairs(spark.createDataFrame(rows, "a long, s double").agg(*pixels.paired_sums("a", "s"))).first()
    x, y = ([Fraction(v) for v in column] for column in zip(*rows, strict=True))
    n, mean = len(rows), lambda v: sum(v) / len(v)
    cov = mean([a * b for a, b in zip(x, y, strict=True)]) - mean(x) * mean(y)
    spread = [float(mean([a * a for a in v]) - mean(v) ** 2) for v in (x, y)]
    assert row.n == n and row.pearson_r == pytest.approx(round(float(cov) / (spread[0] * spread[1]) ** 0.5, 4))
    assert row.mean_difference == pytest.approx(round(float(mean(x) - mean(y)), 2), abs=0.006) and row.rms == pytest.approx(float(mean([(a - b) ** 2 for a, b in zip(x, y, strict=True)])) ** 0.5, abs=0.006)


def test_pairing_prefers_the_latest_created(spark):
    items = spark.createDataFrame([("s", "2024-01-01", "i1"), ("s", None, "i9"), ("s", "2024-02-01", "i2")], "s string, created string, item string")
    row = pairing.latest_created(items, ["s"], created="created", item="item").first()
    assert (row.item, row.candidates) == ("i2", 3)


def test_lag_across_chunks_of_one_key(spark):
    rng = random.Random(1)
    rows = [(1, rng.randrange(1000), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, t int, i int")
    got = {r.i: r.previous_i for r in logs.with_previous(df, ["k"], ["t", "i"], F.floor(F.col("t") / 50), ["i"]).collect()}
    order = sorted(rows, key=lambda r: (r[1], r[2]))
    assert got == {b[2]: (a[2] if a else None) for a, b in zip([None, *order], order, strict=False)}


def test_sleep_pairs_ignore_repeats(spark):
    text = [
        "2024-01-01 00:00:10 +0000 Wake  Wake from", "2024-01-01 01:00:00 +0000 Sleep  Entering Sleep", "2024-01-01 01:00:05 +0000 Sleep  Entering Sleep",
        "noise", "2024-01-02 02:00:00 +0000 DarkWake x", "2024-01-02 03:00:00 +0000 Wake x", "2024-01-02 04:00:00 +0000 Sleep  Entering Sleep",
    ]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(text)], "k int, i int, value string")
    events = logs.power_events(df, "value")
    out = logs.sleep_intervals(events, ["k"], "at", "i", F.date_trunc("day", F.col("at"))).select(F.col("start").cast("string"), F.col("end").cast("string")).collect()
    assert [tuple(r) for r in out] == [("2024-01-01 01:00:00", "2024-01-02 02:00:00")]


def test_log_ranges_and_folders(spark):
    lines = spark.createDataFrame([(1, "VSICURL: Downloading 0-9,20-29 (https://h/a.tif)..."), (1, "VSICURL: GetFileSize(https://h/a.tif)=5"), (1, "x")], "run int, value string")
    row = logs.io_summary(logs.requests(lines, "value", ["run"]), ["run"]).first()
    assert (row.range_requests, row.bytes_requested, row.size_requests, row.requests) == (1, 20, 1, 2)
    assert one(spark, latency.folder_of(F.lit("a/b/c.tif"))) == "b" and one(spark, latency.folder_of(F.lit("c.tif"))) is None


def test_greedy_cover_matches_a_loop(spark):
    rng = random.Random(5)
    pairs = {(r, s, e) for r in range(3) for e in range(40) for s in rng.sample("abcdef", rng.randrange(1, 4))}
    df = spark.createDataFrame(sorted(pairs), "region int, tile string, lake int")
    got = covers.greedy_cover(df, "region", "tile", "lake", {"share": F.count(F.lit(1))}, {"share": "sum"}, [-F.col("share")])
    found = {(r.region, r.round): (r.tile, r.n) for r in got.collect()}
    for region in range(3):
        left = {e for r, _, e in pairs if r == region}
        round_no = 0
        while left:
            round_no += 1
            scores = {s: len({e for r, t, e in pairs if r == region and t == s and e in left}) for s in "abcdef"}
            best = min(scores, key=lambda s: (-scores[s], s))
            assert found[region, round_no] == (best, scores[best])
            left -= {e for r, t, e in pairs if r == region and t == best}
    assigned = covers.cover_assignments(got, df, "region", "tile", "lake")
    assert assigned.count() == 120


def test_connected_groups_follow_long_chains(spark):
    edges = [(i, f"l{i}") for i in range(60)] + [(i + 1, f"l{i}") for i in range(59)] + [(100, "z"), (101, "z")]
    out = covers.connected_groups(spark.createDataFrame(edges, "node long, link string"), "node", "link")
    labels = {r.node: r.label for r in out.collect()}
    assert set(labels[i] for i in range(60)) == {0} and labels[101] == 100


def test_cost_helpers(spark):
    assert one(spark, costs.storage_price(F.lit(60_000.0), (3.0, 2.0, 1.0))) == 51_200 * 3 + 8_800 * 2
    assert one(spark, costs.interpolate(F.lit(9.0), (1.0, 10.0), (3.0, 20.0))) == 20.0
    bins = spark.createDataFrame([(1, 1, 0, 1.0, 5, 1.0), (1, 2, 9, 1.0, 5, 1.0)], "s int, pos int, n int, mean double, total int, area double")
    with pytest.raises(PySparkException):
        costs.close_population(bins, ["s"], "pos", "n", "mean", "total", "area").collect()


def test_primary_tile_rule(spark):
    rows = [("a", "T2", True, 0.70), ("a", "T1", True, 0.695), ("a", "T0", False, 0.99), ("b", "T9", False, 1.0), ("b", "T8", False, 1.0)]
    df = spark.createDataFrame(rows, "body string, tile string, zone boolean, share double")
    got = {(r.body, r.tile): r.role for r in geo.assign_primary_tile(df, "body", "tile", "zone", "share").collect()}
    assert got == {("a", "T1"): "primary", ("a", "T2"): "overlap", ("a", "T0"): "overlap", ("b", "T8"): "primary", ("b", "T9"): "overlap"}


def test_rounding_at_ties_is_half_to_even(spark):
    from tarnscope.functions import scalars as sc

    start = F.timestamp_seconds(F.lit(0))
    hours = [sc.hours_between(start, F.timestamp_seconds(F.lit(s))) for s in (450, 1350, 2250)]
    row = spark.range(1).select(*hours, sc.share(F.lit(1), F.lit(128)), sc.share(F.lit(3), F.lit(128))).first()
    assert list(row) == [0.12, 0.38, 0.62, 0.007812, 0.023438]


def test_unknown_cloud_ranks_last_in_a_cover(spark):
    from tarnscope.operators import covers as cv

    pairs = spark.createDataFrame([("r", "unknown", 1, None), ("r", "cloudy", 1, 50)], "region string, take string, lake int, cloud int")
    merges = {"cloud": F.max(cv.worst_if_unknown("cloud"))}
    rows = cv.greedy_cover(pairs, "region", "take", "lake", merges, {"cloud": "max"}, [F.col("cloud")]).collect()
    assert [(r["take"], r["n"]) for r in rows] == [("cloudy", 1)]


def test_text_ids_break_ties_of_revisions(spark):
    from tarnscope.operators import covers as cv

    rows = [("r", "g", "s", "b-2", 1, "2020-01-02"), ("r", "g", "s", "a-1", 9, "2020-01-02"), ("r", "g", "s", "c-3", 5, "2020-01-01")]
    items = spark.createDataFrame(rows, "region string, grp string, strip string, item string, cloud int, day string").withColumn("at", F.to_timestamp("day"))
    out = cv.rank_datatakes(items.withColumn("uncovered", F.lit(0)), region="region", group="grp", identity=["strip"], created="at", item="item", cloud="cloud", sensing="at", uncovered="uncovered")
    row = out.first()
    assert (row["cloud"], row["items"], row["discarded"]) == (9, 1, 2)


def test_publication_over_a_store_without_its_key_fails(spark, tmp_path):
    from pyspark.errors import AnalysisException

    from tarnscope.streaming.streams import publish_to

    batch = spark.createDataFrame([(1, 5)], "k int, at int")
    write = publish_to(str(tmp_path / "store"), ["k"], "at")
    write(batch, 0)
    assert spark.read.parquet(str(tmp_path / "store")).count() == 1
    spark.createDataFrame([(1,)], "other int").write.parquet(str(tmp_path / "bad" / "batch=0"))
    with pytest.raises(AnalysisException):
        publish_to(str(tmp_path / "bad"), ["k"], "at")(batch, 1)


def test_an_earlier_result_stays_until_a_new_one_is_whole(spark, tmp_path):
    from tarnscope.sources import files as fs

    path = str(tmp_path / "result")
    first = fs.write_result(spark.range(1), path)
    assert fs.latest_result(spark, path).endswith(first.rsplit("/", 1)[1])
    second = fs.write_result(spark.range(2), path)
    (tmp_path / "result" / second.rsplit("/", 1)[1] / "_SUCCESS").unlink()
    assert fs.latest_result(spark, path).endswith(first.rsplit("/", 1)[1])


def test_an_element_that_no_set_covers_is_an_error(spark):
    pairs = spark.createDataFrame([("r", "a", 1), ("r", "b", 1), ("r", "b", 2)], "region string, take string, lake int")
    chosen = covers.greedy_cover(pairs, "region", "take", "lake", {}, {}, [])
    assert {(r["lake"], r["take"]) for r in covers.cover_assignments(chosen, pairs, "region", "take", "lake", pairs).collect()} == {(1, "b"), (2, "b")}
    wanted = spark.createDataFrame([("r", 3)], "region string, lake int")
    with pytest.raises(PySparkException, match="no set covers 3"):
        covers.cover_assignments(chosen, pairs, "region", "take", "lake", wanted).collect()


def test_headline_of_inputs_that_disagree_is_refused(spark):
    from tarnscope.operators import reports

    rows = spark.createDataFrame([(1, True), (2, False)], "v int, complete boolean")
    assert reports.headline(rows.where("complete"), F.col("v") * 1.0, F.col("complete"), "inputs disagree").first()["headline"] == 1.0
    with pytest.raises(PySparkException, match="inputs disagree"):
        reports.headline(rows, F.col("v") * 1.0, F.col("complete"), "inputs disagree").collect()


def test_changed_digest_is_refused(spark):
    from tarnscope.operators import checks

    manifest, found = (spark.createDataFrame([("a", x)], "name string, sha256 string") for x in ("1", "2"))
    assert checks.require_same_digest(manifest, manifest, "name", "sha256").count() == 1
    with pytest.raises(PySparkException, match="digest changed: a"):
        checks.require_same_digest(manifest, found, "name", "sha256").collect()


def test_scratch_is_cleared(spark, tmp_path):
    from tarnscope import session

    class Stub:
        def __init__(self, spark):
            self._jvm, self._jsc, self.conf, self.sparkContext = spark._jvm, spark._jsc, self, self

        def get(self, key, default=None):
            return str(tmp_path)

        def getCheckpointDir(self):
            return str(tmp_path)

    stub = Stub(spark)
    for name in ("a", "b"):
        os.makedirs(session.scratch_path(stub, name))
    (tmp_path / "other").mkdir()
    assert session.clear_scratch(stub) == 2
    assert [p.name for p in tmp_path.iterdir()] == ["other"]
