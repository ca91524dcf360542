"""Admission of items, attempts to repeat, and strata of a cohort."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnscope.operators import geometry as geo
from tarnscope.operators import refusals as rf
from tarnscope.operators import selection as sel
from tarnscope.plans.geometry import headers
from tarnscope.plans.registry import load, query


@query("native_items", "C08 C17", """WITH h AS (SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_linenumber = 7 THEN 'undeclared grid' WHEN l_orderkey % 7 = 0 THEN 'not north-up on the tile origin' WHEN l_partkey % 4 = 3 THEN 'unsupported resolution'
  WHEN l_orderkey % 11 = 0 THEN 'shape differs' END AS reason FROM lineitem)
SELECT k, count(*) AS assets, coalesce(string_agg(DISTINCT n || ': ' || reason, ',' ORDER BY n || ': ' || reason), '') AS problems, CASE WHEN count(reason) > 0 THEN 'an asset has a different native grid' END AS refused FROM h GROUP BY k""")
def _(spark, sf):
    reason = geo.asset_mismatch(F.col("transform"), F.col("shape"), F.lit(600_000.0), F.lit(4_000_020.0), F.lit(10_980), F.lit(10_980))
    out = rf.native_items(headers(spark, sf), ["k"], F.col("n").cast("string"), reason)
    return out.withColumn("problems", F.array_join("problems", ","))


@query("replaced_attempts", "V19", """WITH a AS (SELECT o_custkey AS cohort, o_orderkey % 7 AS configuration, count(*) AS n, count(*) FILTER (o_orderkey % 3 = 0) AS slept, bool_and(o_orderstatus <> 'P') AS complete, bool_and(o_orderkey % 10 <> 9) AS agrees
  FROM orders GROUP BY ALL),
e AS (SELECT DISTINCT o_custkey AS cohort, c AS configuration FROM orders, range(6) r(c)),
j AS (SELECT coalesce(a.cohort, e.cohort) AS cohort, coalesce(a.configuration, e.configuration) AS configuration, CASE WHEN e.cohort IS NULL THEN 'not expected' WHEN a.cohort IS NULL THEN 'not audited' WHEN n > 1 THEN 'audited twice'
  WHEN slept = 0 AND NOT (complete AND agrees) THEN 'incomplete without sleep' END AS refused, slept FROM a FULL JOIN e ON a.cohort = e.cohort AND a.configuration = e.configuration)
SELECT cohort, configuration, CASE WHEN refused IS NOT NULL THEN 'review' WHEN slept > 0 THEN 'replace' ELSE 'keep' END AS action, refused FROM j""")
def _(spark, sf):
    k = F.col("o_orderkey")
    orders = load(spark, sf, "orders")
    audit = orders.select(F.col("o_custkey").alias("cohort"), (k % 7).alias("configuration"), (k % 3 == 0).cast("int").alias("overlaps"), (F.col("o_orderstatus") != "P").alias("complete"), (k % 10 != 9).alias("agrees"))
    expected = orders.select(F.col("o_custkey").alias("cohort"), F.explode(F.sequence(F.lit(0), F.lit(5)).cast("array<bigint>")).alias("configuration"))
    return rf.replacement_attempts(audit, expected, ["cohort", "configuration"])


BOX = (0.0, 0.0, 4800.0, 4000.0)


def points(spark, sf):
    c = F.col("c_custkey")
    return load(spark, sf, "customer").select(
        c.alias("body"), (c * 37 % 5200).cast("double").alias("x"), (c * 91 % 5200).cast("double").alias("y"), F.element_at(F.array(F.lit("small"), F.lit("medium"), F.lit("large")), (c % 3 + 1).cast("int")).alias("band"),
    )


POINTS = "WITH p AS (SELECT c_custkey AS body, c_custkey * 37 % 5200 * 1e0 AS x, c_custkey * 91 % 5200 * 1e0 AS y, ['small', 'medium', 'large'][CAST(c_custkey % 3 AS INT) + 1] AS band FROM customer)"


@query("strata_candidates", "W21", POINTS + """, s AS (SELECT *, CAST(floor(x * 8 / 4800) * 4 + floor(y * 4 / 4000) AS INTEGER) AS stratum FROM p WHERE x < 4800 AND y < 4000)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY stratum, band ORDER BY sha256('n' || body), body) AS INTEGER) AS place FROM s) WHERE place <= 3""")
def _(spark, sf):
    placed = sel.strata(points(spark, sf), "x", "y", BOX, 8, 4)
    return sel.hashed_per_stratum(placed, ["stratum", "band"], F.sha2(F.concat(F.lit("n"), F.col("body").cast("string")), 256), "body", 3)


@query("nearest_centers_by_band", "W21", POINTS + """, d AS (SELECT *, pow((x - 2500) * 88e-2, 2) + pow(y - 2600, 2) AS distance FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY distance, sha256('n' || body), body) AS k FROM d)
SELECT body, x, y, band, round(distance, 4) AS distance FROM r WHERE k <= CASE band WHEN 'small' THEN 20 WHEN 'medium' THEN 10 ELSE 5 END""")
def _(spark, sf):
    ranked = points(spark, sf).withColumn("rank", F.sha2(F.concat(F.lit("n"), F.col("body").cast("string")), 256))
    distance = F.pow((F.col("x") - 2500) * 0.88, 2) + F.pow(F.col("y") - 2600, 2)
    near = sel.nearest_by_band(ranked, "band", {"small": 20, "medium": 10, "large": 5}, distance, ["rank", "body"])
    return near.select("body", "x", "y", "band", F.round("distance", 4).alias("distance"))
