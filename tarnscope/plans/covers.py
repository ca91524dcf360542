"""Cover, sample and plan queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnscope.functions.scalars import stable_key
from tarnscope.operators import covers as cv
from tarnscope.plans.extraction import digest_sql
from tarnscope.plans.registry import load, query


def tile_pairs(spark, sf):
    return load(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("region"), F.col("l_linenumber").alias("tile"), F.col("l_partkey").alias("lake"), F.col("l_quantity").cast("bigint").alias("share")
    )


def rounds_sql(base: str, region: str, chooser: str, element: str, score: str, order: str, rounds: int, out: str, finish: str | None = None) -> str:
    """The greedy loop unrolled for the known number of sets per region; ``finish`` reads ``chosen``."""
    parts = [base]
    left = "pairs"
    for i in range(1, rounds + 1):
        parts.append(f"s{i} AS (SELECT {region}, {chooser}, count(DISTINCT {element}) AS n, {score} FROM {left} GROUP BY ALL)")
        parts.append(f"w{i} AS (SELECT *, {i} AS round FROM (SELECT *, row_number() OVER (PARTITION BY {region} ORDER BY n DESC, {order}, {chooser}) AS rn FROM s{i}) WHERE rn = 1)")
        parts.append(
            f"l{i} AS (SELECT * FROM {left} p WHERE NOT EXISTS (SELECT 1 FROM {left} q JOIN w{i} w ON q.{region} = w.{region} AND q.{chooser} = w.{chooser} "
            f"WHERE q.{region} = p.{region} AND q.{element} = p.{element}))"
        )
        left = f"l{i}"
    union = " UNION ALL ".join(f"SELECT {out} FROM w{i}" for i in range(1, rounds + 1))
    if finish:
        return ",\n".join([*parts, f"chosen AS ({union})"]) + "\n" + finish
    return ",\n".join(parts) + "\n" + union


@query("greedy_tile_cover", "W10 W11", rounds_sql(
    "WITH pairs AS (SELECT l_suppkey AS region, l_linenumber AS tile, l_partkey AS lake, CAST(l_quantity AS BIGINT) AS share FROM lineitem)",
    "region", "tile", "lake", "CAST(sum(share) AS BIGINT) AS share", "share DESC", 7, "region, tile, n, share, round"))
def _(spark, sf):
    return cv.greedy_cover(tile_pairs(spark, sf), "region", "tile", "lake", {"share": F.sum("share")}, {"share": "sum"}, [-F.col("share")])


@query("cover_assigned_lakes", "W12 W25", rounds_sql(
    "WITH pairs AS (SELECT l_suppkey AS region, l_linenumber AS tile, l_partkey AS lake, CAST(l_quantity AS BIGINT) AS share FROM lineitem)",
    "region", "tile", "lake", "CAST(sum(share) AS BIGINT) AS share", "share DESC", 7, "region, tile, round",
    "SELECT region, lake, arg_min(c.tile, c.round) AS tile, min(c.round) AS round FROM pairs p JOIN chosen c USING (region, tile) GROUP BY region, lake"))
def _(spark, sf):
    pairs = tile_pairs(spark, sf)
    chosen = cv.greedy_cover(pairs, "region", "tile", "lake", {"share": F.sum("share")}, {"share": "sum"}, [-F.col("share")])
    wanted = load(spark, sf, "lineitem").select(F.col("l_suppkey").alias("region"), F.col("l_partkey").alias("lake")).distinct()
    return cv.cover_assignments(chosen, pairs, "region", "tile", "lake", wanted)


@query("greedy_acquisition_cover", "W12 W25", rounds_sql(
    """WITH pairs AS (SELECT o_custkey % 25 AS region, o_orderpriority AS datatake, o_custkey AS lake, o_orderkey % 5 AS uncovered,
  CASE WHEN o_orderkey % 997 = 5 THEN CAST('inf' AS DOUBLE) ELSE CAST(floor(o_totalprice) AS BIGINT) % 101 END AS cloud, epoch(o_orderdate) AS sensed FROM orders)""",
    "region", "datatake", "lake", "max(uncovered) AS uncovered, max(cloud) AS cloud, CAST(min(sensed) AS BIGINT) AS sensed", "uncovered, cloud, sensed DESC", 5,
    "region, datatake, n, uncovered, cloud, sensed, round"))
def _(spark, sf):
    o = load(spark, sf, "orders").select(
        (F.col("o_custkey") % 25).alias("region"), F.col("o_orderpriority").alias("datatake"), F.col("o_custkey").alias("lake"),
        (F.col("o_orderkey") % 5).alias("uncovered"), F.when(F.col("o_orderkey") % 997 != 5, F.floor("o_totalprice") % 101).alias("cloud"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("sensed"),
    )
    merges = {"uncovered": F.max("uncovered"), "cloud": F.max(cv.worst_if_unknown("cloud")), "sensed": F.min("sensed")}
    return cv.greedy_cover(
        o, "region", "datatake", "lake", merges, {"uncovered": "max", "cloud": "max", "sensed": "min"}, [F.col("uncovered"), F.col("cloud"), -F.col("sensed")]
    )


SPREAD = """WITH c AS (SELECT c_nationkey AS stratum, c_custkey AS item, (c_custkey * 37 % 1000) / 1e1 AS x, (c_custkey * 91 % 600) / 1e1 AS y,
  CASE WHEN c_acctbal < 2000 THEN 'small' WHEN c_acctbal < 6000 THEN 'medium' ELSE 'large' END AS band, sha256('7:' || c_custkey) AS key FROM customer)"""


def spread_sql() -> str:
    parts, held = [SPREAD], None
    for i, band in enumerate(("small", "medium", "large"), start=1):
        if held is None:
            d = "0e0"
            src = "c"
        else:
            d = f"(SELECT min(pow((c.x - h.x) * cos(radians(c.y)), 2) + pow(c.y - h.y, 2)) FROM {held} h WHERE h.stratum = c.stratum)"
            src = f"c WHERE NOT EXISTS (SELECT 1 FROM {held} h WHERE h.item = c.item)"
        parts.append(f"d{i} AS (SELECT c.*, {d} AS dist FROM {src})")
        parts.append(
            f"p{i} AS (SELECT stratum, item, x, y, band, {i} AS round FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY band <> '{band}', dist DESC, key, item) AS rn FROM d{i}) WHERE rn = 1)"
        )
        parts.append(f"h{i} AS (" + (f"SELECT * FROM {held} UNION ALL " if held else "") + f"SELECT * FROM p{i})")
        held = f"h{i}"
    return ",\n".join(parts) + f"\nSELECT stratum, item, x, y, band, round FROM {held} WHERE round < 3 OR stratum IN (SELECT stratum FROM p3 ORDER BY stratum LIMIT 10)"


@query("spread_sample", "W13 W21", spread_sql())
def _(spark, sf):
    k = F.col("c_custkey")
    c = load(spark, sf, "customer").select(
        F.col("c_nationkey").alias("stratum"), k.alias("item"), (k * 37 % 1000 / 10.0).alias("x"), (k * 91 % 600 / 10.0).alias("y"),
        F.when(F.col("c_acctbal") < 2000, "small").when(F.col("c_acctbal") < 6000, "medium").otherwise("large").alias("band"),
    )
    return cv.spread_sample(c, "stratum", "item", "x", "y", "band", ("small", "medium", "large"), stable_key(F.col("item").cast("string"), "7"), 60)


EDGES = """WITH RECURSIVE e AS (SELECT c_custkey AS node, 'a' || (c_custkey // 3) AS link FROM customer
  UNION SELECT c_custkey, 'b' || CAST(floor(c_acctbal) AS BIGINT) FROM customer),
n AS (SELECT DISTINCT a.node AS x, b.node AS y FROM e a JOIN e b USING (link)),
r(x, y) AS (SELECT x, y FROM n UNION SELECT r.x, n.y FROM r JOIN n ON r.y = n.x)
SELECT x AS node, min(y) AS label FROM r GROUP BY x"""


@query("acquisition_groups", "D24", EDGES)
def _(spark, sf):
    k = F.col("c_custkey")
    links = F.array(F.concat(F.lit("a"), F.floor(k / 3)), F.concat(F.lit("b"), F.floor("c_acctbal")))
    edges = load(spark, sf, "customer").select(k.alias("node"), F.explode(links).alias("link"))
    return cv.connected_groups(edges, "node", "link")


@query("band_quotas", "W14", """WITH a AS (SELECT 'balance ' || CAST(floor(c_acctbal / 2500) AS BIGINT) AS band, count(*) AS n FROM customer GROUP BY ALL),
l AS (SELECT band, unnest(generate_series(1, n)) AS k FROM a), f AS (SELECT * FROM l ORDER BY k, band LIMIT 1200)
SELECT band, count(*) AS quota FROM f GROUP BY band""")
def _(spark, sf):
    band = F.concat(F.lit("balance "), F.floor(F.col("c_acctbal") / 2500).cast("string"))
    a = load(spark, sf, "customer").groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))
    return cv.quotas(a.withColumn("position", F.col("band")), "band", "n", "position", 1200)


@query("nearest_width_by_class", "W15 W22", """WITH p AS (SELECT p_brand AS region, p_partkey AS source_id, p_size AS width, unnest([10, 20, 50]) AS size_class FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY region, size_class ORDER BY round(abs(ln(width / CAST(size_class AS DOUBLE))), 12), source_id) AS rn FROM p)
SELECT region, size_class, source_id, width FROM r WHERE rn = 1""")
def _(spark, sf):
    p = load(spark, sf, "part").select(F.col("p_brand").alias("region"), F.col("p_partkey").alias("source_id"), F.col("p_size").alias("width"))
    return cv.nearest_by_class(p, ["region"], "width", "source_id", [10, 20, 50])


@query("run_plan", "W16 W17 W18 W19 B50 B62", """WITH r AS (SELECT s_suppkey AS tile, unnest([1, 2, 3]) AS repetition FROM supplier),
p AS (SELECT *, unnest(range(3)) AS i FROM r), m AS (SELECT *, unnest(range(2)) AS j FROM p)
SELECT tile, repetition, ['tile','lake','block'][(i + repetition - 1) % 3 + 1] AS pattern, ['raster','lists'][(j + repetition - 1) % 2 + 1] AS method, i * 2 + j AS position FROM m""")
def _(spark, sf):
    s = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("tile"))
    out = cv.plan_rows(s, ["tile"], ["tile", "lake", "block"], ["raster", "lists"], 3)
    return out.withColumn("position", F.col("position").cast("bigint"))


@query("ranked_datatakes", "W07 U02", """WITH i AS (SELECT o_custkey % 25 AS region, o_custkey AS grp, strftime(o_orderdate, '%Y-%m') AS strip, o_orderdate AS created, 'item-' || o_orderkey AS item,
  CASE WHEN o_orderkey % 9 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) % 101 END AS cloud, o_orderdate AS sensing, o_orderkey % 4 AS uncovered FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY region, grp, strip ORDER BY created DESC, item) AS rn, count(*) OVER (PARTITION BY region, grp, strip) - 1 AS d FROM i),
s AS (SELECT region, grp, max(uncovered) AS uncovered, CASE WHEN count(*) FILTER (cloud IS NULL) = 0 THEN max(cloud) END AS cloud, min(sensing) AS earliest,
  count(*) AS items, CAST(sum(d) AS BIGINT) AS discarded FROM r WHERE rn = 1 GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY uncovered, cloud ASC NULLS LAST, earliest DESC, grp) AS rn FROM s)
SELECT region, grp AS datatake, uncovered, cloud, items, discarded FROM b WHERE rn = 1""")
def _(spark, sf):
    o = load(spark, sf, "orders").select(
        (F.col("o_custkey") % 25).alias("region"), F.col("o_custkey").alias("datatake"), F.date_format("o_orderdate", "yyyy-MM").alias("strip"),
        F.col("o_orderdate").alias("created"), F.concat(F.lit("item-"), "o_orderkey").alias("item"),
        F.when(F.col("o_orderkey") % 9 != 0, F.floor("o_totalprice") % 101).alias("cloud"), F.col("o_orderdate").alias("sensing"), (F.col("o_orderkey") % 4).alias("uncovered"),
    )
    return cv.rank_datatakes(
        o, region="region", group="datatake", identity=["strip"], created="created", item="item", cloud="cloud", sensing="sensing", uncovered="uncovered"
    )


@query("sample_item_per_software", "W20 A28", """SELECT l_returnflag AS collection, l_shipdate::DATE::VARCHAR AS software, l_linenumber AS baseline,
  min(l_partkey * 1000 + l_suppkey) AS item, count(*) AS seen FROM lineitem GROUP BY ALL""")
def _(spark, sf):
    return load(spark, sf, "lineitem").groupBy(
        F.col("l_returnflag").alias("collection"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("software"), F.col("l_linenumber").alias("baseline")
    ).agg(F.min(F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("item"), F.count(F.lit(1)).alias("seen"))


@query("hashed_candidates", "C03 A28 B41", """SELECT CAST(l_partkey AS VARCHAR) AS id, min(sha256('20260916:' || l_partkey)) AS rank FROM lineitem WHERE l_quantity * 10000 >= 20000 GROUP BY ALL""")
def _(spark, sf):
    from tarnscope.operators.selection import hashed_candidates

    li = load(spark, sf, "lineitem").where(F.col("l_quantity") * 10000 >= 20000)
    ids = li.select(F.col("l_partkey").cast("string").alias("id"))
    return hashed_candidates(ids, source_id="id", rank=stable_key(F.col("id"), "20260916"))


@query("manifest_summary", "W22 W23 W24", f"""WITH m AS (SELECT s_nationkey AS region, s_suppkey AS body, s_suppkey * 13 % 150 + 1 AS width,
  s_suppkey = min(s_suppkey) OVER (PARTITION BY s_nationkey) AS anchor FROM supplier)
SELECT region, count(*) AS bodies, count(*) FILTER (anchor) AS anchors, CAST(sum(width) AS BIGINT) AS width_sum, {digest_sql("body || '|' || width")} AS digest FROM m GROUP BY region""")
def _(spark, sf):
    from tarnscope.functions.digests import set_digest

    s = load(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("region"), F.col("s_suppkey").alias("body"), (F.col("s_suppkey") * 13 % 150 + 1).alias("width")
    )
    first = s.groupBy("region").agg(F.min("body").alias("body")).withColumn("anchor", F.lit(True))
    m = s.join(first, ["region", "body"], "left")
    one = cv.require_one(m, ["region"], F.col("anchor"), "a region needs exactly one anchor").select("region", F.col("n").alias("anchors"))
    out = m.groupBy("region").agg(
        F.count(F.lit(1)).alias("bodies"), F.sum("width").alias("width_sum"), set_digest(F.col("body"), F.col("width")).alias("digest")
    )
    return out.join(one, "region")


@query("frozen_plan_digest", "W08 W26 W09 V01 V02 B48 B49", f"""WITH k AS (SELECT l_suppkey AS lake, l_linenumber AS band, l_returnflag AS item, count(*) AS n, min(l_partkey) AS low FROM lineitem GROUP BY ALL)
SELECT lake, count(*) AS expected, CAST(sum(n) AS BIGINT) AS pixels, {digest_sql("lake || '|' || band || '|' || item || '|' || low")} AS plan_digest, lake % 5 <> 0 AS unchanged FROM k GROUP BY lake""")
def _(spark, sf):
    from tarnscope.functions.digests import set_digest

    def plan(moved):
        """The plan; a plan made later has other items for the lakes where ``moved`` is one."""
        low = (F.min("l_partkey") + F.max(moved)).alias("low")
        return load(spark, sf, "lineitem").groupBy(
            F.col("l_suppkey").alias("lake"), F.col("l_linenumber").alias("band"), F.col("l_returnflag").alias("item")
        ).agg(F.count(F.lit(1)).alias("n"), low)

    digest = set_digest(F.col("lake"), F.col("band"), F.col("item"), F.col("low")).alias("plan_digest")
    frozen = plan(F.lit(0)).groupBy("lake").agg(F.count(F.lit(1)).alias("expected"), F.sum("n").alias("pixels"), digest)
    later = F.when(F.col("l_suppkey") % 5 == 0, 1).otherwise(0)
    again = plan(later).groupBy("lake").agg(digest).withColumnRenamed("plan_digest", "_now")
    return frozen.join(again, "lake").withColumn("unchanged", F.col("plan_digest") == F.col("_now")).drop("_now")


@query("dropped_bodies", "W27 D35 D36", """WITH f AS (SELECT l_suppkey AS body, count(*) AS candidates, count(*) FILTER (l_returnflag = 'R') AS complete, max(l_partkey) AS top FROM lineitem GROUP BY ALL),
c AS (SELECT body FROM f WHERE body % 7 <> 0), p AS (SELECT body FROM f WHERE body % 7 <> 0 AND top % 3 <> 0)
SELECT s_suppkey AS body, coalesce(f.candidates, 0) AS candidates, coalesce(f.complete, 0) AS complete, CASE WHEN c.body IS NULL THEN 'no candidate' WHEN p.body IS NULL THEN 'no complete product' ELSE 'kept' END AS reason
FROM supplier LEFT JOIN f ON s_suppkey = f.body LEFT JOIN c ON s_suppkey = c.body LEFT JOIN p ON s_suppkey = p.body""")
def _(spark, sf):
    found = load(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("body")).agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("l_returnflag") == "R").alias("complete"), F.max("l_partkey").alias("top")
    )
    s = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("body")).join(found, "body", "left")
    reason = F.when(F.col("top").isNull() | (F.col("body") % 7 == 0), "no candidate").when(F.col("top") % 3 == 0, "no complete product").otherwise("kept")
    return s.select("body", F.coalesce("candidates", F.lit(0)).alias("candidates"), F.coalesce("complete", F.lit(0)).alias("complete"), reason.alias("reason"))
