"""Bindings of the two-level summaries, baselines and payload ratios."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnscope.functions.scalars import rounded
from tarnscope.operators import summaries as sm
from tarnscope.plans.registry import load, query

RUNS = """WITH r AS (SELECT l_suppkey AS tile, l_linestatus AS method, l_linenumber AS repetition, count(*) AS requests, CAST(sum(l_partkey) AS BIGINT) AS bytes,
  CASE WHEN count(*) FILTER (l_tax > 7e-2) = 0 THEN 'ok' ELSE 'band_errors' END AS status FROM lineitem GROUP BY ALL)"""


def runs(spark, sf):
    r = load(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("tile"), F.col("l_linestatus").alias("method"), F.col("l_linenumber").alias("repetition")).agg(
        F.count(F.lit(1)).alias("requests"), F.sum("l_partkey").alias("bytes"), F.count_if(F.col("l_tax") > 0.07).alias("bad")
    )
    return r.withColumn("status", F.when(F.col("bad") == 0, "ok").otherwise("band_errors"))


@query("spread_of_clean_runs", "F44 F49", RUNS + """ SELECT tile, method, count(*) FILTER (status = 'ok') AS runs, count(*) FILTER (status <> 'ok') AS excluded,
  median(requests) FILTER (status = 'ok') AS requests_median, min(requests) FILTER (status = 'ok') AS requests_min, max(requests) FILTER (status = 'ok') AS requests_max,
  median(bytes) FILTER (status = 'ok') AS bytes_median, min(bytes) FILTER (status = 'ok') AS bytes_min, max(bytes) FILTER (status = 'ok') AS bytes_max FROM r GROUP BY ALL""")
def _(spark, sf):
    return sm.spread_of_runs(runs(spark, sf), ["tile", "method"], "status", ["requests", "bytes"])


LAKES = """WITH b AS (SELECT l_partkey AS lake, l_linenumber AS run, l_quantity AS pixels, l_suppkey AS bytes FROM lineitem),
s AS (SELECT lake, run, sum(pixels) AS pixels, sum(bytes) AS bytes FROM b GROUP BY ALL),
m AS (SELECT lake, count(*) AS runs, median(pixels) AS pixels, median(bytes) AS bytes FROM s GROUP BY lake)"""


def lake_medians(spark, sf):
    b = load(spark, sf, "lineitem").select(F.col("l_partkey").alias("lake"), F.col("l_linenumber").alias("run"), F.col("l_quantity").alias("pixels"), F.col("l_suppkey").alias("bytes"))
    return sm.medians_of_sums(b, ["run"], ["lake"], ["pixels", "bytes"])


@query("lake_medians", "F50", LAKES + " SELECT lake, runs, pixels, bytes FROM m")
def _(spark, sf):
    return lake_medians(spark, sf)


@query("class_medians_of_lake_medians", "F46", LAKES + """ SELECT CASE WHEN p_size <= 10 THEN 10 WHEN p_size <= 20 THEN 20 ELSE 50 END AS size_class, count(*) AS bodies, median(pixels) AS pixels, median(bytes) AS bytes
FROM m JOIN part ON p_partkey = lake GROUP BY ALL""")
def _(spark, sf):
    size = F.when(F.col("p_size") <= 10, 10).when(F.col("p_size") <= 20, 20).otherwise(50)
    p = load(spark, sf, "part").select(F.col("p_partkey").alias("lake"), size.alias("size_class"))
    return sm.medians_by_class(lake_medians(spark, sf).join(p, "lake"), "size_class", ["pixels", "bytes"])


@query("preparation_by_class", "F47", """SELECT p_size // 10 AS size_class, l_linenumber % 3 AS resolution, count(*) AS masks, median(l_quantity) AS pixels, max(l_quantity) AS most
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL""")
def _(spark, sf):
    p = load(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.floor(F.col("p_size") / 10).cast("int").alias("size_class"))
    m = load(spark, sf, "lineitem").join(p, "l_partkey").select("size_class", (F.col("l_linenumber") % 3).alias("resolution"), "l_quantity")
    counts = m.groupBy("size_class", "resolution").agg(F.count(F.lit(1)).alias("masks"), F.max("l_quantity").alias("most"))
    return sm.with_medians(counts, m, ["size_class", "resolution"], {"l_quantity": "pixels"}, 8.0)


@query("run_status_counts", "F52 V22", RUNS + """ SELECT s_suppkey AS tile, coalesce(count(status), 0) AS runs, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'band_errors') AS band_errors,
  count(*) FILTER (status IS NULL) > 0 AS no_run, count(DISTINCT repetition) FILTER (status = 'ok') = 7 AS complete FROM supplier LEFT JOIN r ON tile = s_suppkey GROUP BY s_suppkey""")
def _(spark, sf):
    s = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("tile")).join(runs(spark, sf), "tile", "left")
    return s.groupBy("tile").agg(
        F.count("status").alias("runs"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "band_errors").alias("band_errors"),
        (F.count_if(F.col("status").isNull()) > 0).alias("no_run"), (F.count_distinct(F.when(F.col("status") == "ok", F.col("repetition"))) == 7).alias("complete"),
    )


@query("baseline_sums", "D37", """WITH b AS (SELECT l_orderkey AS item, l_partkey AS lake, median(l_quantity) AS pixels FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL),
w AS (SELECT DISTINCT l_orderkey AS item, l_partkey AS lake FROM lineitem)
SELECT item, count(b.lake) AS with_baseline, coalesce(string_agg(CAST(w.lake AS VARCHAR), ',' ORDER BY w.lake) FILTER (b.lake IS NULL), '') AS without, sum(pixels) AS pixels FROM w LEFT JOIN b USING (item, lake) GROUP BY item""")
def _(spark, sf):
    rows = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_partkey").alias("lake"), "l_quantity", "l_returnflag")
    earlier = rows.where("l_returnflag <> 'R'").groupBy("item", "lake").agg(F.median("l_quantity").alias("pixels"))
    out = sm.baseline_sums(rows.select("item", "lake").distinct(), earlier, "item", "lake", ["pixels"])
    return out.withColumn("without", F.array_join(F.col("without").cast("array<string>"), ","))


@query("payload_ratios", "F61 K19", """SELECT l_suppkey AS product, round_even(sum(l_partkey) / CAST(nullif(sum(l_quantity * 100), 0) AS DOUBLE), 6) AS ratio_all,
  round_even(sum(l_partkey) FILTER (l_linenumber <= 3) / CAST(nullif(sum(l_quantity * 100) FILTER (l_linenumber <= 3), 0) AS DOUBLE), 6) AS ratio_measured FROM lineitem GROUP BY ALL""")
def _(spark, sf):
    o = load(spark, sf, "lineitem").select(F.col("l_suppkey").alias("product"), F.col("l_partkey").alias("size"), (F.col("l_quantity") * 100).cast("double").alias("native"), "l_linenumber")
    out = sm.payload_ratio(o, ["product"], "size", "native", F.col("l_linenumber") <= 3)
    return out.select("product", *[rounded(F.col(c), 6).alias(c) for c in ("ratio_all", "ratio_measured")])


@query("payload_density", "F62", """SELECT o_custkey AS scene_group, min(o_orderpriority) = max(o_orderpriority) AS layers_agree, round_even(sum(o_totalprice) / CAST(sum(o_orderkey % 100 + 1) AS DOUBLE), 4) AS bytes_per_km2 FROM orders GROUP BY ALL""")
def _(spark, sf):
    o = load(spark, sf, "orders").select(F.col("o_custkey").alias("scene_group"), F.col("o_orderpriority").alias("layers"), F.col("o_totalprice").cast("double").alias("native"), (F.col("o_orderkey") % 100 + 1).alias("area"))
    out = sm.payload_density(o, ["scene_group"], "layers", "native", "area")
    return out.withColumn("bytes_per_km2", rounded(F.col("bytes_per_km2"), 4))


@query("transfer_estimates", "F56 F57", """WITH m AS (SELECT l_linenumber AS configuration, l_returnflag AS pattern, median(l_partkey) AS md, min(l_partkey) AS lo, max(l_partkey) AS hi,
  min(CASE WHEN l_returnflag = 'R' AND l_linenumber = 2 THEN 512 ELSE 2048 END) AS a, max(CASE WHEN l_returnflag = 'R' AND l_linenumber = 2 THEN 512 ELSE 2048 END) AS b FROM lineitem GROUP BY ALL),
p AS (SELECT DISTINCT l_linenumber + 1 AS configuration, l_returnflag AS pattern FROM lineitem), j AS (SELECT *, configuration * 10 AS members, CASE WHEN a IS NULL THEN 'not measured' WHEN a <> 2048 OR b <> 2048 THEN 'other settings' END AS refused FROM p LEFT JOIN m USING (configuration, pattern))
SELECT configuration, pattern, refused, CASE WHEN refused IS NULL THEN members * md END AS median, CASE WHEN refused IS NULL THEN members * lo END AS low, CASE WHEN refused IS NULL THEN members * hi END AS high FROM j""")
def _(spark, sf):
    li = load(spark, sf, "lineitem").select(F.col("l_linenumber").alias("configuration"), F.col("l_returnflag").alias("pattern"), F.col("l_partkey").alias("bytes"))
    other = (F.col("pattern") == "R") & (F.col("configuration") == 2)
    measured = li.withColumn("chunk", F.when(other, 512).otherwise(2048))
    plan = li.select((F.col("configuration") + 1).alias("configuration"), "pattern").distinct()
    plan = plan.withColumns({"members": F.col("configuration") * 10, "chunk": F.lit(2048)})
    return sm.transfer_estimate(plan, measured, ["configuration", "pattern"], "members", "bytes", "chunk")


@query("restricted_snapshot", "D34 D43", "SELECT o_orderkey AS item, o_custkey AS tile FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def _(spark, sf):
    keep = load(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("item"))
    return sm.restricted(load(spark, sf, "orders").select(F.col("o_orderkey").alias("item"), F.col("o_custkey").alias("tile")), keep, ["item"])


@query("scenes_of_earlier_probe", "V24 V25", "SELECT DISTINCT l_orderkey AS scene, l_suppkey AS reference FROM lineitem WHERE l_returnflag = 'A'")
def _(spark, sf):
    probe = load(spark, sf, "lineitem").where("l_returnflag = 'A'")
    return probe.select(F.col("l_orderkey").alias("scene"), F.col("l_suppkey").alias("reference")).distinct()


@query("preferred_claims", "D30", """WITH c AS (SELECT l_suppkey AS candidate, l_returnflag AS field, l_partkey AS claim FROM lineitem),
b AS (SELECT candidate, field, arg_min(claim, (CAST(claim <> candidate AS INT), claim)) AS claim, count(*) AS sources FROM c GROUP BY ALL),
s AS (SELECT s_suppkey AS candidate, unnest(['A', 'N', 'R', 'X']) AS field FROM supplier)
SELECT candidate, field, claim, coalesce(sources, 0) AS sources, claim IS NULL AS gap FROM s LEFT JOIN b USING (candidate, field)""")
def _(spark, sf):
    claims = load(spark, sf, "lineitem").select(F.col("l_suppkey").alias("candidate"), F.col("l_returnflag").alias("field"), F.col("l_partkey").alias("claim"))
    fields = F.array(*[F.lit(f) for f in ("A", "N", "R", "X")])
    spine = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("candidate"), F.explode(fields).alias("field"))
    return sm.preferred_claims(spine, claims, "candidate", "field", "claim")


@query("values_with_nodata", "X15", """SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 0 ELSE CAST(floor(value) AS BIGINT) END AS dn FROM events""")
def _(spark, sf):
    value = F.when(F.col("event_id") % 9 == 0, F.lit(float("nan"))).otherwise(F.floor("value").cast("double"))
    return load(spark, sf, "events").select("event_id", sm.nodata_for_nan(value, F.lit(0)).alias("dn"))
