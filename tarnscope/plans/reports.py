"""Report queries over the coverage marts and lineitem workloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnscope.functions.scalars import normalized_difference, usable_class
from tarnscope.operators import reports as rp
from tarnscope.operators.coverage import fallback_by_month
from tarnscope.operators.quantiles import linear
from tarnscope.plans.coverage import FALLBACK, GAPS, fallback, gaps
from tarnscope.plans.extraction import blocks
from tarnscope.plans.registry import load, query

BY_MONTH = GAPS + "," + FALLBACK.split("FROM orders),\nspine AS", 1)[1].split("INTERVAL 1 MONTH)) AS m))", 1)[1].lstrip(", \n") + """,
fb AS (SELECT tile, month, count(*) FILTER (coverage_class = 'complete_cog') AS fill, count(*) FILTER (coverage_class IN ('none', 'partial_cog', 'jp2_only')) AS rest FROM missing GROUP BY ALL),
bm AS (SELECT month, CAST(sum(reference) AS BIGINT) AS reference, CAST(sum(present) AS BIGINT) AS present, CAST(sum(fill) AS BIGINT) AS fill, CAST(sum(uncovered) AS BIGINT) AS uncovered FROM (
  SELECT month, reference, "primary" AS present, 0 AS fill, 0 AS uncovered FROM gaps UNION ALL SELECT month, 0, 0, fill, rest FROM fb) GROUP BY month)"""
BY_MONTH = BY_MONTH.replace("per_key AS (\n  SELECT tile, month, key, coalesce(max(rnk), 0)", "fallback_key AS (\n  SELECT tile, month, key, coalesce(max(rnk), 0)").replace(
    "best_item, best_baseline FROM per_key WHERE NOT p)", "best_item, best_baseline FROM fallback_key WHERE NOT p)")


def by_month(spark, sf):
    return rp.coverage_by_month(gaps(spark, sf), fallback_by_month(fallback(spark, sf), ["tile", "month"]))


query("coverage_by_month", "F66", BY_MONTH + " SELECT * FROM bm")(lambda spark, sf: by_month(spark, sf))


@query("coverage_strip", "F67 F68", BY_MONTH + """ SELECT *, round(present / CAST(nullif(reference, 0) AS DOUBLE), 6) AS share, round((present + fill) / CAST(nullif(reference, 0) AS DOUBLE), 6) AS share_filled,
  least(CAST(floor(present / CAST(nullif(reference, 0) AS DOUBLE) * 10) AS INT), 10) AS shade, least(CAST(floor((present + fill) / CAST(nullif(reference, 0) AS DOUBLE) * 10) AS INT), 10) AS shade_filled FROM bm WHERE reference > 0""")
def _(spark, sf):
    return rp.coverage_strip(by_month(spark, sf)).where("reference > 0")


@query("gap_report_findings", "D38 F82 F88 F90 F95", GAPS + """, t AS (SELECT sum(reference) AS reference, sum("primary") AS present, sum(missing) AS missing, sum(covered_by_fallback) AS covered, sum(uncovered) AS uncovered,
  count(*) AS tile_months, count(*) FILTER (status = 'complete') AS complete, count(*) FILTER (status = 'empty') AS empty, count(*) FILTER (status = 'partial') AS partial,
  count(*) FILTER (status = 'no_reference') AS no_reference, count(DISTINCT tile) AS tiles, count(DISTINCT month) AS months FROM gaps)
SELECT f.finding, CAST(f.value AS DOUBLE) AS value FROM t, LATERAL (VALUES ('reference', reference), ('present', present), ('missing', missing), ('covered', covered), ('uncovered', uncovered), ('tile_months', tile_months),
  ('complete', complete), ('empty', empty), ('partial', partial), ('no_reference', no_reference), ('tiles', tiles), ('months', months)) f(finding, value)""")
def _(spark, sf):
    g, status = gaps(spark, sf), F.col("status")
    names = (
        "reference", "present", "missing", "covered", "uncovered", "tile_months", "complete", "empty", "partial", "no_reference", "tiles",
        "months",
    )
    totals = g.agg(
        F.sum("reference").alias("reference"), F.sum("primary").alias("present"), F.sum("missing").alias("missing"), F.sum("covered_by_fallback").alias("covered"),
        F.sum("uncovered").alias("uncovered"), F.count(F.lit(1)).alias("tile_months"), *[F.count_if(status == s).alias(s) for s in ("complete", "empty", "partial", "no_reference")],
        F.count_distinct("tile").alias("tiles"), F.count_distinct("month").alias("months"),
    )
    return rp.findings(totals, names)


@query("asset_layouts", "F65 F41", """WITH l AS (SELECT o_orderpriority AS layout, o_orderstatus AS status, o_custkey % 9 AS baseline, count(*) AS n FROM orders GROUP BY ALL)
SELECT layout, status, string_agg(CAST(baseline AS VARCHAR), ',' ORDER BY baseline) AS "values", CAST(sum(n) AS BIGINT) AS n FROM l GROUP BY ALL""")
def _(spark, sf):
    o = load(spark, sf, "orders").select(F.col("o_orderpriority").alias("layout"), F.col("o_orderstatus").alias("status"), (F.col("o_custkey") % 9).alias("baseline"))
    out = rp.layouts(o, ["layout", "status"], "baseline")
    return out.withColumn("values", F.array_join(F.col("values").cast("array<string>"), ","))


def workloads(spark, sf):
    return load(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("reader"), F.col("l_suppkey").alias("cohort"), F.col("l_linestatus").alias("option")).agg(
        F.count(F.lit(1)).alias("requests"), F.sum("l_partkey").alias("bytes"), (F.max("l_orderkey") >= 0).alias("complete")
    )


@query("option_workloads", "F69 F85 F81 F84 F89", """WITH w AS (SELECT l_linenumber AS reader, l_suppkey AS cohort, l_linestatus AS o, count(*) AS requests, sum(l_partkey) AS bytes FROM lineitem GROUP BY ALL)
SELECT reader, cohort, sum(1) FILTER (o = 'O') AS "runs_O", sum(1) FILTER (o = 'F') AS "runs_F", CAST(sum(requests) FILTER (o = 'O') AS BIGINT) AS "requests_O", CAST(sum(requests) FILTER (o = 'F') AS BIGINT) AS "requests_F",
  CAST(sum(bytes) FILTER (o = 'O') AS BIGINT) AS "bytes_O", CAST(sum(bytes) FILTER (o = 'F') AS BIGINT) AS "bytes_F",
  round(sum(requests) FILTER (o = 'O') / CAST(nullif(sum(requests) FILTER (o = 'F'), 0) AS DOUBLE), 6) AS requests_ratio, round(sum(bytes) FILTER (o = 'O') / CAST(nullif(sum(bytes) FILTER (o = 'F'), 0) AS DOUBLE), 6) AS bytes_ratio
FROM w GROUP BY ALL""".replace("sum(1) FILTER (o = 'O')", "CAST(sum(1) FILTER (o = 'O') AS BIGINT)").replace("sum(1) FILTER (o = 'F')", "CAST(sum(1) FILTER (o = 'F') AS BIGINT)"))
def _(spark, sf):
    return rp.option_workloads(workloads(spark, sf), ["reader", "cohort"], "option", ["O", "F"], ["requests", "bytes"])


@query("headline_ratios", "F82 F83 F88", """SELECT l_suppkey AS cohort, round(count(*) FILTER (l_linestatus = 'O') / CAST(count(*) AS DOUBLE), 6) AS headline FROM lineitem GROUP BY ALL""")
def _(spark, sf):
    w = workloads(spark, sf).groupBy("cohort").agg(
        F.sum(F.when(F.col("option") == "O", F.col("requests")).otherwise(0)).alias("mine"), F.sum("requests").alias("all"), F.bool_and("complete").alias("complete")
    )
    out = rp.headline(w, F.round(F.col("mine") / F.col("all"), 6), F.col("complete") & (F.col("mine") <= F.col("all")), "inputs disagree")
    return out.select("cohort", "headline")


@query("largest_variant_difference", "F86 F92", """WITH d AS (SELECT l_suppkey AS sensor, l_linenumber AS band, max(CAST(l_quantity AS BIGINT)) AS diff FROM lineitem GROUP BY ALL),
r AS (SELECT *, rank() OVER (PARTITION BY sensor ORDER BY diff DESC) AS rk FROM d) SELECT sensor, max(diff) AS diff, string_agg(CAST(band AS VARCHAR), ',' ORDER BY CAST(band AS VARCHAR)) AS names FROM r WHERE rk = 1 GROUP BY sensor""")
def _(spark, sf):
    d = load(spark, sf, "lineitem").select(F.col("l_suppkey").alias("sensor"), F.col("l_linenumber").alias("band"), F.col("l_quantity").cast("bigint").alias("diff"))
    return rp.largest_with_ties(d, ["sensor"], "diff", "band")


@query("percent_ranges", "B63 F83", """WITH s AS (SELECT l_suppkey AS k, l_linenumber AS n, round(count(*) FILTER (l_linestatus = 'O') / CAST(count(*) AS DOUBLE), 4) AS s FROM lineitem GROUP BY ALL),
r AS (SELECT k, CAST(CAST(round_even(min(s) * 100, 0) AS BIGINT) AS VARCHAR) AS a, CAST(CAST(round_even(max(s) * 100, 0) AS BIGINT) AS VARCHAR) AS b FROM s GROUP BY k)
SELECT k, CASE WHEN a = b THEN a ELSE a || ' to ' || b END AS text FROM r""")
def _(spark, sf):
    s = load(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("k"), "l_linenumber").agg(
        F.round(F.count_if(F.col("l_linestatus") == "O") / F.count(F.lit(1)), 4).alias("s")
    )
    return s.groupBy("k").agg(rp.percent_range(F.min("s"), F.max("s")).alias("text"))


@query("issue_placements", "F94", """SELECT o_orderkey AS issue, count(l_orderkey) AS placements, CASE WHEN count(l_orderkey) = 0 THEN 'not placed' WHEN count(l_orderkey) > 1 THEN 'placed twice' ELSE 'ok' END AS state
FROM orders LEFT JOIN (SELECT * FROM lineitem) l ON o_orderkey = l_orderkey GROUP BY ALL""")
def _(spark, sf):
    placed = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("issue"), F.col("l_partkey").alias("place"))
    issues = load(spark, sf, "orders").select(F.col("o_orderkey").alias("issue")).join(placed, "issue", "left")
    return rp.placed_once(issues, "issue")


@query("earlier_digest_families", "D45 V26 F51", """WITH d AS (SELECT l_suppkey AS lake, l_returnflag AS family, sha256(CAST(l_partkey % 50 AS VARCHAR)) AS digest FROM lineitem)
SELECT lake, family, count(DISTINCT digest) AS digests, min(digest) AS first_digest, max(digest) AS last_digest, count(*) AS records FROM d GROUP BY ALL""")
def _(spark, sf):
    d = load(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("lake"), F.col("l_returnflag").alias("family"), F.sha2((F.col("l_partkey") % 50).cast("string"), 256).alias("digest")
    )
    return rp.families(d, ["lake", "family"], "digest")


@query("preflight_numbers", "F58 V21", """WITH p AS (SELECT o_custkey % 5 AS cohort, o_orderkey, o_custkey, o_orderdate, CAST(floor(o_totalprice) AS BIGINT) AS area FROM orders)
SELECT cohort, min(area) AS low, round(median(area), 2) AS median, max(area) AS high, count(DISTINCT o_custkey) AS products, count(DISTINCT o_custkey % 25) AS tiles, count(DISTINCT (o_custkey % 25, o_orderdate)) AS tile_dates, count(*) AS memberships FROM p GROUP BY cohort""")
def _(spark, sf):
    p = load(spark, sf, "orders").select(
        (F.col("o_custkey") % 5).alias("cohort"), "o_custkey", (F.col("o_custkey") % 25).alias("tile"), "o_orderdate", F.floor("o_totalprice").alias("area")
    )
    spread = linear(p, ["cohort"], "area", {"median": 0.5}, bucket=1024).select(
        "cohort", F.col("min").alias("low"), F.round("median", 2).alias("median"), F.col("max").alias("high")
    )
    counts = p.groupBy("cohort").agg(
        F.count_distinct("o_custkey").alias("products"), F.count_distinct("tile").alias("tiles"), F.count_distinct("tile", "o_orderdate").alias("tile_dates"), F.count(F.lit(1)).alias("memberships")
    )
    return spread.join(counts, "cohort")


@query("index_map_statistics", "B64 T09", """WITH e AS (SELECT vec_id, label, unnest(embedding) AS f, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
p AS (SELECT label AS item, (vec_id + pos) % 12 AS scl, CASE WHEN (vec_id + pos) % 11 = 0 THEN 0 ELSE CAST(floor(CAST(f AS DOUBLE) * 10000 + 5e-1) AS BIGINT) END AS red,
  CASE WHEN (vec_id + pos) % 11 = 0 THEN 0 ELSE CAST(floor(CAST(f AS DOUBLE) * 10000 + 5e-1) AS BIGINT) + 37 END AS nir FROM e),
r AS (SELECT item, scl IN (4, 5, 6, 7) AND red <> 0 AND nir <> 0 AS valid, red * 1e-4 + 6e-1 AS a, nir * 1e-4 + 6e-1 AS b FROM p)
SELECT item, count(*) AS pixels, count(*) FILTER (valid AND a + b > 1e-6) AS usable, round(min(CASE WHEN valid THEN greatest(-1, least(1, (b - a) / (b + a))) END), 6) AS low, round(max(CASE WHEN valid THEN greatest(-1, least(1, (b - a) / (b + a))) END), 6) AS high FROM r GROUP BY item""")
def _(spark, sf):
    e = blocks(spark, sf).where("band in ('red', 'nir')").groupBy("item", "br", "bc").pivot("band", ["red", "nir"]).agg(F.first("values"))
    p = e.select("item", (F.col("br") * 32 + F.col("bc")).alias("vec_id"), F.posexplode(F.arrays_zip("red", "nir")).alias("pos", "v"))
    scl = (F.col("vec_id") + F.col("pos")) % 12
    red, nir = F.col("v.red"), F.col("v.nir")
    valid = usable_class(scl, (red == 0) | (nir == 0))
    a, b = red * 1e-4 + 0.6, nir * 1e-4 + 0.6
    value = F.when(valid, normalized_difference(b, a))
    return p.groupBy("item").agg(
        F.count(F.lit(1)).alias("pixels"), F.count_if(valid & (a + b > 1e-6)).alias("usable"), F.round(F.min(value), 6).alias("low"), F.round(F.max(value), 6).alias("high")
    )


@query("paired_candidates_by_month", "D42 V20 V23 C09", """WITH c AS (SELECT o_orderkey AS k, o_custkey % 25 AS tile, strftime(o_orderdate, '%Y-%m') AS month FROM orders), p AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R')
SELECT tile, month, count(*) AS candidates, count(p.k) AS paired FROM c LEFT JOIN p USING (k) GROUP BY ALL""")
def _(spark, sf):
    c = load(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 25).alias("tile"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    p = load(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k")).distinct().withColumn("hit", F.lit(1))
    return c.join(p, "k", "left").groupBy("tile", "month").agg(F.count(F.lit(1)).alias("candidates"), F.count("hit").alias("paired"))
