"""Stage collation: suppliers are members, lineitems records of runs by method."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnscope.operators import collation as co
from tarnscope.operators.extraction import row_differences
from tarnscope.plans.registry import load, query
from tarnscope.session import cut_lineage, scratch_path

KEYS = ["tile", "member", "band", "resolution"]
BANDS = ("red", "nir", "scl", "nope")
PLANNED = 4
CHECKS = ("mask_methods_identical", "naive_identical", "naive_matches_wet", "matches_earlier")


def members(spark, sf):
    return load(spark, sf, "supplier").select((F.col("s_nationkey") % 10).cast("bigint").alias("tile"), F.col("s_suppkey").alias("member"))


def assets(spark, sf):
    """Every tile resolves three bands but where a pattern says; none resolves the last."""
    tiles = members(spark, sf).select("tile").distinct()
    rows = tiles.select("tile", F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.lit(r).alias("resolution")) for b, r in (("red", 10), ("nir", 10), ("scl", 20))])).alias("a")).select("tile", "a.*")
    return rows.where(~((F.col("tile") % 4 == 2) & (F.col("band") == "scl")))


def records(spark, sf):
    """A record per lineitem: its supplier's, of one band, by one of four runs of which the last clips naively."""
    k, n, m = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey")
    run = F.col("l_partkey") % PLANNED
    band = F.element_at(F.array(F.lit("red"), F.lit("nir"), F.lit("scl")), (n % 3 + 1).cast("int"))
    naive = run == 3
    digest = F.concat_ws("-", m, n % 3)
    rows = load(spark, sf, "lineitem").select(
        m.alias("member"), band.alias("band"), F.when(n % 3 == 2, 20).otherwise(10).alias("resolution"), run.alias("run"), F.when(naive, "naive").otherwise("mask").alias("method"),
        F.when((m % 9 == 4) & (run == 1), F.concat(digest, F.lit("x"))).when((m % 13 == 5) & (run == 2), F.lit(None)).when(naive, F.concat(F.lit("w"), digest)).otherwise(digest).alias("digest_all"),
        F.when(~naive, F.when(m % 7 == 3, F.lit("other")).otherwise(F.concat(F.lit("w"), digest))).alias("digest_wet"), k.alias("k"),
    )
    return rows.join(members(spark, sf), "member")


def earlier(spark, sf):
    m = F.col("member")
    rows = members(spark, sf).where(m % 3 != 1).withColumn("n", F.explode(F.array(F.lit(0), F.lit(1))))
    return rows.select(
        "tile", "member", F.element_at(F.array(F.lit("red"), F.lit("nir")), F.col("n") + 1).alias("band"), F.lit(10).alias("resolution"),
        F.when(m % 10 == 6, "old").otherwise(F.concat(F.lit("w"), F.concat_ws("-", m, "n"))).alias("digest"),
    )


def equality(spark, sf):
    expected = co.expected_bands(members(spark, sf), members(spark, sf), assets(spark, sf), BANDS)
    return co.method_equality(records(spark, sf), expected, earlier(spark, sf), KEYS, PLANNED, "naive")


STAGE = """WITH members AS (SELECT CAST(s_nationkey % 10 AS BIGINT) AS tile, s_suppkey AS member FROM supplier),
exp AS (SELECT tile, member, band, CASE WHEN band = 'nope' OR band = 'scl' AND tile % 4 = 2 THEN NULL WHEN band = 'scl' THEN 20 ELSE 10 END AS resolution FROM members, (VALUES ('red'), ('nir'), ('scl'), ('nope')) b(band)),
rec AS (SELECT tile, member, ['red', 'nir', 'scl'][CAST(l_linenumber % 3 AS INT) + 1] AS band, CASE WHEN l_linenumber % 3 = 2 THEN 20 ELSE 10 END AS resolution, l_partkey % 4 AS run, member || '-' || (l_linenumber % 3) AS d
  FROM lineitem JOIN members ON member = l_suppkey),
dig AS (SELECT *, CASE WHEN member % 9 = 4 AND run = 1 THEN d || 'x' WHEN member % 13 = 5 AND run = 2 THEN NULL WHEN run = 3 THEN 'w' || d ELSE d END AS a, CASE WHEN run <> 3 THEN CASE WHEN member % 7 = 3 THEN 'other' ELSE 'w' || d END END AS w FROM rec),
found AS (SELECT tile, member, band, resolution, count(DISTINCT run) AS records,
  CASE WHEN count(*) FILTER (run <> 3) > 0 THEN count(DISTINCT a) FILTER (run <> 3) = 1 AND count(*) FILTER (run <> 3 AND a IS NULL) = 0 END AS mask_methods_identical,
  CASE WHEN count(*) FILTER (run = 3) > 0 THEN count(DISTINCT a) FILTER (run = 3) = 1 AND count(*) FILTER (run = 3 AND a IS NULL) = 0 END AS naive_identical,
  list_sort(list(DISTINCT a) FILTER (run = 3 AND a IS NOT NULL)) AS nv, list_sort(list(DISTINCT w) FILTER (w IS NOT NULL)) AS wt FROM dig GROUP BY ALL),
before AS (SELECT tile, member, ['red', 'nir'][n + 1] AS band, 10 AS resolution, CASE WHEN member % 10 = 6 THEN 'old' ELSE 'w' || member || '-' || n END AS digest FROM members, (VALUES (0), (1)) v(n) WHERE member % 3 <> 1),
keys AS (SELECT tile, member, band, resolution, resolution IS NOT NULL AS resolved FROM exp UNION ALL SELECT tile, member, band, resolution, FALSE FROM found f WHERE NOT EXISTS (SELECT 1 FROM exp e WHERE e.member = f.member AND e.band = f.band AND e.resolution = f.resolution)),
rows AS (SELECT k.tile, k.member, k.band, k.resolution, resolved, coalesce(records, 0) AS records, coalesce(records, 0) = 4 AS complete, 4 - coalesce(records, 0) AS missing, mask_methods_identical, naive_identical,
  CASE WHEN len(nv) > 0 AND len(wt) > 0 THEN nv = wt END AS naive_matches_wet, CASE WHEN len(wt) > 0 AND digest IS NOT NULL THEN wt = [digest] END AS matches_earlier, CASE WHEN digest IS NOT NULL THEN TRUE END AS earlier_consistent
  FROM keys k LEFT JOIN found f ON f.member = k.member AND f.band = k.band AND f.resolution = k.resolution LEFT JOIN before b ON b.member = k.member AND b.band = k.band AND b.resolution = k.resolution)"""


query("stage_equality", "F51 F53 V20", STAGE + " SELECT * FROM rows")(lambda spark, sf: equality(spark, sf))

LEVELS = [[], ["tile"], ["tile", "band"], ["band"]]
LEVEL_SQL = STAGE + """, g AS (SELECT tile, band, grouping(tile) AS gt, grouping(band) AS gb, count(*) AS expected, count(*) FILTER (complete) AS complete, count(*) FILTER (NOT complete) AS incomplete, count(*) FILTER (NOT resolved) AS unresolved, CAST(sum(records) AS BIGINT) AS records, """ + ", ".join(
    f"count(*) FILTER ({c}) AS {c}_yes, count(*) FILTER (NOT {c}) AS {c}_no" for c in CHECKS
) + """ FROM rows GROUP BY GROUPING SETS ((), (tile), (tile, band), (band)))
SELECT CASE WHEN gt = 1 AND gb = 1 THEN 'all' WHEN gb = 1 THEN 'tile' WHEN gt = 1 THEN 'band' ELSE 'tile+band' END AS level, * EXCLUDE (gt, gb) FROM g"""


@query("stage_levels", "F20 V20 F51", LEVEL_SQL)
def _(spark, sf):
    return co.stage_levels(equality(spark, sf), LEVELS, CHECKS)


@query("summary_of_stored_stage", "V22", """SELECT 'first' AS side, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'changed', CAST(1 AS BIGINT)""")
def _(spark, sf):
    """A summary computed anew from the stored rows equals the first one; from changed rows it does not."""
    path = scratch_path(spark, "stage")
    rows = equality(spark, sf)
    first = cut_lineage(co.stage_levels(rows, LEVELS, CHECKS))
    rows.write.parquet(path)
    stored = spark.read.schema(rows.schema).parquet(path)
    changed = stored.withColumn("complete", F.when(F.col("member") == stored.select(F.min("member")).scalar(), ~F.col("complete")).otherwise(F.col("complete")))
    names = first.columns
    parts = None
    for side, source in (("first", stored), ("changed", changed)):
        differs = row_differences(first, co.stage_levels(source, LEVELS, CHECKS), names).agg(F.least(F.count(F.lit(1)), F.lit(1)).alias("n")).select(F.lit(side).alias("side"), "n")
        parts = differs if parts is None else parts.unionByName(differs)
    return parts


CONFIGURATIONS = """WITH n AS (SELECT DISTINCT 'reader' || (o_custkey % 24) AS configuration, o_custkey % 24 AS i FROM orders),
s AS (SELECT configuration, i, i % 5 <> 0 AS tried, i % 7 <> 1 AS ended, i % 6 <> 2 AS filled FROM n),
w AS (SELECT *, tried AND ended AND filled AS whole FROM s)"""


def configured(spark, sf, kinds):
    orders = load(spark, sf, "orders").select(F.concat(F.lit("reader"), F.col("o_custkey") % 24).alias("configuration"), (F.col("o_custkey") % 24).alias("i"))
    names = orders.distinct()
    attempts = names.where("i % 5 <> 0").select("configuration", (F.col("i") % 7 != 1).alias("ended"))
    results = orders.groupBy("configuration", "i").agg(F.count(F.lit(1)).alias("rows"))
    results = results.select("configuration", "rows", (F.col("rows") + F.when(F.col("i") % 6 == 2, 1).otherwise(0)).alias("expected"), F.concat(F.lit("s"), (F.col("i") % kinds).cast("string")).alias("signature"))
    return co.configuration_status(names, attempts, results)


def status_sql(bad: str, matches: str) -> str:
    return CONFIGURATIONS + f" SELECT configuration, CASE WHEN NOT tried THEN 'not_attempted' WHEN NOT whole THEN 'incomplete' ELSE '{bad}' END AS status, CASE WHEN whole THEN {matches} END AS matches_all FROM w"


query("configuration_status_equal", "F75 F70", status_sql("complete", "TRUE"))(lambda spark, sf: configured(spark, sf, 1))
query("configuration_status_differs", "F75", status_sql("differs", "FALSE"))(lambda spark, sf: configured(spark, sf, 2))
