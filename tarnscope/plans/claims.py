"""Claims are orders and their checks lineitems; sensors are suppliers and their bands lineitems."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnscope.functions.canonical import canonical_json, json_digest
from tarnscope.operators import claims as cl
from tarnscope.plans.registry import load, query


def text(prefix, value):
    return F.concat(F.lit(prefix), value.cast("string"))


def checks(spark, sf):
    """The first line of an order checks it, the second too where a pattern says; some checks are faulty."""
    k, n, p = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")
    rows = load(spark, sf, "lineitem").where((k % 5 != 0) & ((n == 1) | ((n == 2) & (k % 11 == 0))))
    verdict = F.when(F.col("l_suppkey") % 40 == 7, "maybe").when(F.col("l_returnflag") == "A", "confirmed").when(F.col("l_returnflag") == "N", "corrected").otherwise("not_verifiable")
    return rows.select(text("c", k).alias("claim"), F.when(p % 50 == 0, "chk-x").otherwise(text("chk-c", k)).alias("check"), verdict.alias("verdict"), F.when(p % 45 != 0, F.col("l_quantity").cast("bigint")).alias("approved"))


def drafts(spark, sf):
    k = F.col("o_orderkey")
    return load(spark, sf, "orders").select(
        text("c", k).alias("claim"), F.when(k % 4 == 0, "estimated").otherwise("documented").alias("status"), (k % 1000).alias("value"),
        F.array(text("s", k % 150 + 1), text("s", F.col("o_custkey") * 2)).alias("source_ids"), F.array(text("c", k - 1), text("c", k - 2)).alias("basis"),
        F.when(k % 12 != 0, "because").alias("reasoning"),
    )


def sources(spark, sf):
    return load(spark, sf, "part").select(text("s", F.col("p_partkey")).alias("source"))


CHECKS = """checks AS (SELECT 'c' || l_orderkey AS claim, CASE WHEN l_partkey % 50 = 0 THEN 'chk-x' ELSE 'chk-c' || l_orderkey END AS "check",
  CASE WHEN l_suppkey % 40 = 7 THEN 'maybe' WHEN l_returnflag = 'A' THEN 'confirmed' WHEN l_returnflag = 'N' THEN 'corrected' ELSE 'not_verifiable' END AS verdict,
  CASE WHEN l_partkey % 45 <> 0 THEN CAST(l_quantity AS BIGINT) END AS approved FROM lineitem WHERE l_orderkey % 5 <> 0 AND (l_linenumber = 1 OR l_linenumber = 2 AND l_orderkey % 11 = 0)),
faulty AS (SELECT *, CASE WHEN "check" = 'chk-x' THEN 'check does not name its claim' WHEN verdict = 'maybe' THEN 'unknown verdict'
  WHEN verdict IN ('confirmed', 'corrected') AND approved IS NULL THEN 'no approved values' END AS fault FROM checks),
one AS (SELECT claim, arg_min({'c': "check", 'v': verdict, 'a': approved, 'f': fault}, "check") AS x, count(*) AS n FROM faulty GROUP BY 1),
indexed AS (SELECT claim, x.c AS "check", x.v AS verdict, x.a AS approved, CASE WHEN n > 1 THEN 'checked twice' ELSE x.f END AS fault FROM one)"""
DOCUMENTED = f"""WITH {CHECKS}, src AS (SELECT 's' || p_partkey AS source FROM part),
d AS (SELECT 'c' || o_orderkey AS claim, o_orderkey AS k, o_orderkey % 1000 AS value, ['s' || (o_orderkey % 150 + 1), 's' || (o_custkey * 2)] AS ids FROM orders),
u AS (SELECT claim, string_agg(DISTINCT s, ',' ORDER BY s) AS unknown FROM (SELECT claim, unnest(ids) AS s FROM d WHERE k % 4 <> 0) WHERE s NOT IN (SELECT source FROM src) GROUP BY 1),
doc AS (SELECT claim, k, approved, "check", CASE WHEN "check" IS NULL THEN 'no check record' WHEN fault IS NOT NULL THEN fault WHEN verdict NOT IN ('confirmed', 'corrected') THEN verdict
  WHEN unknown IS NOT NULL THEN 'unknown sources: ' || unknown END AS reason FROM d LEFT JOIN indexed USING (claim) LEFT JOIN u USING (claim) WHERE k % 4 <> 0),
est AS (SELECT claim, k, value, (SELECT string_agg(o.claim, ',' ORDER BY o.claim) FROM doc o WHERE o.reason IS NULL AND o.k IN (e.k - 1, e.k - 2)) AS basis FROM d e WHERE k % 4 = 0)"""


@query("claims_with_basis", "D29 D32", DOCUMENTED + """ SELECT claim, 'documented' AS status, reason IS NULL AS bound, reason, CASE WHEN reason IS NULL THEN approved END AS value, CASE WHEN reason IS NULL THEN "check" END AS "check", CAST(NULL AS VARCHAR) AS basis FROM doc
UNION ALL SELECT claim, 'estimated', basis IS NOT NULL AND k % 12 <> 0, CASE WHEN basis IS NULL OR k % 12 = 0 THEN 'estimate without a documented basis' END, CASE WHEN basis IS NOT NULL AND k % 12 <> 0 THEN value END, NULL,
  CASE WHEN k % 12 <> 0 THEN basis END FROM est""")
def _(spark, sf):
    bound = cl.bound_claims(drafts(spark, sf), cl.indexed_checks(checks(spark, sf)), sources(spark, sf))
    return bound.withColumn("basis", F.array_join("basis", ","))


@query("claim_source_chains", "D31 D29", DOCUMENTED + """, refs AS (SELECT 'c' || o_orderkey AS claim, unnest(['c' || (o_orderkey - 1), 'c' || (o_orderkey - 2)]) AS cites FROM orders WHERE o_orderkey % 4 = 0
  UNION ALL SELECT claim, unnest(ids) FROM d WHERE k % 4 <> 0),
two AS (SELECT claim, cites AS cited, 1 AS depth FROM refs UNION ALL SELECT a.claim, b.cites, 2 FROM refs a JOIN refs b ON b.claim = a.cites),
steps AS (SELECT claim, cited, min(depth) AS depth FROM two WHERE claim IN (SELECT claim FROM est) GROUP BY ALL)
SELECT claim, cited, depth, cited NOT IN (SELECT claim FROM d) AND cited NOT IN (SELECT source FROM src) AS unknown FROM steps""")
def _(spark, sf):
    rows = drafts(spark, sf)
    estimates = rows.where("status = 'estimated'")
    refs = estimates.select("claim", F.explode("basis").alias("cites")).unionByName(rows.where("status = 'documented'").select("claim", F.explode("source_ids").alias("cites")))
    closure = cl.cited_closure(refs, estimates)
    unknown = cl.unknown_sources(closure, rows, sources(spark, sf)).withColumn("unknown", F.lit(True))
    return closure.join(unknown, ["claim", "cited"], "left").select("claim", "cited", F.col("depth").cast("int").alias("depth"), F.coalesce("unknown", F.lit(False)).alias("unknown"))


def bands(spark, sf):
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    band = F.concat_ws("-", k, n)
    uses = F.array_distinct(F.array(F.col("l_partkey") % 25, k % 25))
    return load(spark, sf, "lineitem").select(F.col("l_suppkey").alias("sensor"), band.alias("band"), F.concat(F.lit("band-"), band).alias("claim"), uses.alias("uses"), k.alias("k"), n.alias("n"), "l_returnflag")


@query("bound_sensor_bands", "D33 D31 D32", """WITH b AS (SELECT l_suppkey AS sensor, l_orderkey || '-' || l_linenumber AS band, l_partkey % 25 AS u1, l_orderkey % 25 AS u2, l_orderkey AS k, l_linenumber AS n, l_returnflag AS f, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1 AS twice FROM lineitem),
r AS (SELECT *, CASE WHEN sensor % 7 = 3 THEN 'sensor is not bound' WHEN k % 6 = 0 THEN 'no check record' WHEN twice THEN 'checked twice' WHEN f = 'R' THEN 'not_verifiable'
  WHEN n = 3 OR n = 5 OR n = 4 AND k % 3 = 0 THEN 'not one wavelength form' WHEN k % 13 = 0 THEN 'adds an undrafted use' END AS reason FROM b)
SELECT sensor, band, reason IS NULL AS bound, reason, CASE WHEN reason IS NULL THEN CASE WHEN n % 2 = 0 THEN 'center' ELSE 'range' END END AS form,
  CASE WHEN reason IS NULL THEN array_to_string(list_sort(list_distinct(list_filter([u1, u2], lambda u: list_contains(known, u)))), ',') END AS uses,
  CASE WHEN reason IS NULL THEN 'chk-band-' || band END AS "check" FROM r, (SELECT list(CAST(n_nationkey AS BIGINT)) AS known FROM nation WHERE n_regionkey <> 3)""")
def _(spark, sf):
    drafted = bands(spark, sf)
    n, k = F.col("n"), F.col("k")
    center = (n % 2 == 0) | (n == 3)
    approved = F.struct(
        F.when(center, 500).alias("center"), F.when(center & ~((n == 4) & (k % 3 == 0)), 20).alias("width"), F.when((n % 2 == 1) & (n != 5), "400-500").alias("range"),
        F.when(k % 13 == 0, F.concat("uses", F.array(F.lit(99).cast("bigint")))).otherwise(F.col("uses")).alias("uses"),
    )
    verdict = F.when(F.col("l_returnflag") == "A", "confirmed").when(F.col("l_returnflag") == "N", "corrected").otherwise("not_verifiable")
    checked = drafted.where(k % 6 != 0).select("claim", F.concat(F.lit("chk-"), "claim").alias("check"), verdict.alias("verdict"), approved.alias("approved"))
    sensors = load(spark, sf, "supplier").where("s_suppkey % 7 <> 3").select(F.col("s_suppkey").alias("sensor"))
    uses = load(spark, sf, "nation").where("n_regionkey <> 3").select(F.col("n_nationkey").cast("bigint").alias("use"))
    out = cl.bound_bands(drafted.select("sensor", "band", "claim", "uses"), cl.indexed_checks(checked), sensors, uses)
    return out.withColumn("uses", F.array_join("uses", ","))


@query("research_check_pairs", "D46", """WITH s AS (SELECT 'd' || o_orderkey AS stem, o_orderkey AS k FROM orders) SELECT stem, stem || '-research.json' AS research, stem || '-checks.json' AS checks FROM s WHERE k % 3 <> 0 AND k % 5 <> 0""")
def _(spark, sf):
    k = F.col("o_orderkey")
    names = F.concat(F.when(k % 3 != 0, F.array(F.lit("-research.json"))).otherwise(F.array().cast("array<string>")), F.when(k % 5 != 0, F.array(F.lit("-checks.json"))).otherwise(F.array().cast("array<string>")), F.array(F.lit("-notes.txt")))
    files = load(spark, sf, "orders").select(text("d", k).alias("stem"), F.explode(names).alias("ending")).select(F.concat("stem", "ending").alias("path"))
    return cl.file_pairs(files, "path")


@query("json_digests", "B48 B60", """SELECT o_orderkey AS k, '{"deep":{"x":100,"y":[1,{"a":null,"b":' || (o_custkey % 10) || '}]},"key":' || o_orderkey || ',"status":"' || o_orderstatus || '"}' AS canonical, TRUE AS same, TRUE AS changed FROM orders""")
def _(spark, sf):
    k, c, s = (F.col(n).cast("string") for n in ("o_orderkey", "o_custkey", "o_orderstatus"))
    last = (F.col("o_custkey") % 10).cast("string")
    a = F.concat(F.lit('{"status": "'), s, F.lit('", "key": '), k, F.lit(', "deep": {"y": [1.0, {"b": '), last, F.lit(', "a": null}], "x": 1e2}}'))
    b = F.concat(F.lit('{"deep":{"x":100.0,"y":[1,{"a":null,"b":'), last, F.lit('.00}]},"key":'), k, F.lit('.0,"status":"'), s, F.lit('"}'))
    kind = F.col("o_orderkey") % 4
    other = F.when(kind == 0, F.replace(b, F.lit("null"), F.lit("0"))).when(kind == 1, F.replace(b, F.lit("100.0"), F.lit('"100"'))).when(kind == 2, F.replace(b, F.lit("[1,"), F.lit("[1,1,"))).otherwise(F.replace(b, F.lit('"a"'), F.lit('"A"')))
    return load(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), canonical_json(a).alias("canonical"), (json_digest(a) == json_digest(b)).alias("same"), (json_digest(a) != json_digest(other)).alias("changed"))
