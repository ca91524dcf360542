"""Pairing and latency queries: scenes are orders, candidates and objects are lineitems."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnscope.functions import names as nm
from tarnscope.functions import scalars as sc
from tarnscope.operators import latency as lat
from tarnscope.operators import pairing as pr
from tarnscope.plans.derived import PRODUCTS, products
from tarnscope.plans.registry import load, query


def scenes_and_items(spark, sf):
    o = load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("product"), F.col("o_orderkey").alias("pass_id"),
        F.expr("substr('ANR', cast(o_orderkey % 3 as int) + 1, 1)").alias("baseline"),
    )
    i = load(spark, sf, "lineitem").select(
        F.when(F.col("l_orderkey") % 5 == 0, -F.col("l_orderkey")).otherwise(F.col("l_orderkey")).alias("pass_id"),
        F.when(F.col("l_linestatus") == "O", 0).otherwise(1).alias("rank"),
        F.col("l_returnflag").alias("baseline"),
        (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("item"),
    )
    return o, i


RANKED = """WITH s AS (SELECT o_orderkey AS product, substr('ANR', CAST(o_orderkey % 3 AS INT) + 1, 1) AS baseline FROM orders),
i AS (SELECT CASE WHEN l_orderkey % 5 = 0 THEN -l_orderkey ELSE l_orderkey END AS product, CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END AS rank, l_returnflag AS baseline,
  l_partkey * 10 + l_linenumber AS item FROM lineitem),
h AS (SELECT s.product, i.rank, i.item, s.baseline = i.baseline AS same,
  min(i.rank) OVER (PARTITION BY s.product) AS best FROM s LEFT JOIN i USING (product)),
m AS (SELECT product, max(best) AS collection_rank, count(item) AS hits, count(item) FILTER (same) AS same_n,
  min(item) FILTER (same) AS si, min(item) AS ai FROM h WHERE rank IS NULL OR rank = best GROUP BY product),
matches AS (SELECT product, collection_rank, CASE WHEN hits = 0 THEN 'none' WHEN same_n = 1 THEN 'exact'
  WHEN same_n > 1 THEN 'exact_multiple' WHEN hits = 1 THEN 'other_baseline' ELSE 'other_multiple' END AS status,
  CASE WHEN same_n > 0 THEN same_n ELSE hits END AS joined, coalesce(si, ai) AS first_item FROM m)"""


@query("ranked_collection_join", "D01", RANKED + " SELECT * FROM matches")
def _(spark, sf):
    s, i = scenes_and_items(spark, sf)
    return pr.match_collections(s, i, ["pass_id"], product="product", baseline="baseline", rank="rank", item="item")


@query("ranked_collection_items", "D01 V23", RANKED + """
SELECT h.product, h.item FROM h JOIN matches m USING (product)
WHERE h.rank = m.collection_rank AND (m.status NOT IN ('exact', 'exact_multiple') OR h.same)""")
def _(spark, sf):
    s, i = scenes_and_items(spark, sf)
    args = dict(product="product", baseline="baseline", rank="rank", item="item")
    matches = pr.match_collections(s, i, ["pass_id"], **args)
    return pr.joined_items(matches, s, i, ["pass_id"], **args)


def two_hop(spark, sf):
    p = products(spark, sf)
    k = F.col("k")
    scenes = p.select(
        "k", "product", "tile", "platform", "generation", nm.l1c_name(F.col("product")).alias("l1c")
    )
    later = F.when(k % 13 == 0, F.date_format(F.expr("sensing_ts + interval 25 seconds"), "yyyyMMdd'T'HHmmss"))
    # The name is long to make; as a value of a row it is made once, not again in every condition on it.
    named = p.where(k % 10 != 0).select(F.inline(F.array(F.struct(nm.l1c_name(F.col("product")).alias("l1c"), F.array(F.col("sensing"), later).alias("strips")))))
    declared = named.select("l1c", F.explode("strips").alias("strip"))
    strips = pr.datastrips_by_name(declared, name="l1c", strip="strip")
    li = load(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("k"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("created"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("c1"),
    )
    li = pr.latest_created(li, ["k"], created="created", item="c1", more=["created"])
    c1 = li.join(p.select("k", "tile", "platform", F.col("sensing").alias("strip")), "k").drop("k").withColumnRenamed("item", "c1")
    return pr.pair_products(
        scenes, strips, c1, product="product", name="l1c", tile="tile", platform="platform",
        strip="strip", created="created", item="c1", weight="candidates",
    )


TWO_HOP = f"""WITH {PRODUCTS}, l AS (
  SELECT l_orderkey AS k, strftime(l_shipdate, '%Y-%m-%d') AS created,
    l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS c1
  FROM lineitem),
c1 AS (SELECT p.tile, p.platform, p.sensing AS strip, l.created, l.c1 FROM l JOIN products p USING (k)),
latest AS (SELECT tile, platform, strip, arg_max(c1, (created, c1)) AS item, count(*) AS candidates FROM c1 GROUP BY ALL),
hop AS (SELECT k, product, tile, platform, generation,
  CASE WHEN k % 10 = 0 THEN 0 WHEN k % 13 = 0 THEN 2 ELSE 1 END AS strips,
  CASE WHEN k % 10 <> 0 AND k % 13 <> 0 THEN sensing END AS datastrip FROM products),
pairs AS (SELECT h.k, h.product, h.generation, h.datastrip, l.item AS c1_item, greatest(coalesce(l.candidates, 0) - 1, 0) AS alternatives,
  CASE WHEN h.strips = 0 THEN 'no_l1c_item' WHEN h.strips > 1 THEN 'l1c_ambiguous' WHEN l.item IS NULL THEN 'no_c1_item'
    WHEN l.candidates = 1 THEN 'datastrip' ELSE 'datastrip_multiple' END AS pair_status
  FROM hop h LEFT JOIN latest l ON h.tile = l.tile AND h.platform = l.platform AND h.datastrip = l.strip)"""


@query("two_hop_pairing", "D02 D03 B14", TWO_HOP + " SELECT k, product, datastrip, c1_item, alternatives, pair_status FROM pairs")
def _(spark, sf):
    return two_hop(spark, sf).select("k", "product", "datastrip", "c1_item", "alternatives", "pair_status")


@query("product_per_item", "D04", TWO_HOP + """, w AS (
  SELECT c1_item, arg_max(product, (generation, product)) AS winner FROM pairs WHERE k % 8 <> 0 AND c1_item IS NOT NULL GROUP BY ALL)
SELECT product, CASE WHEN k % 8 <> 0 THEN c1_item END AS c1_item,
  CASE WHEN k % 8 = 0 THEN 'incomplete_layers' WHEN c1_item IS NOT NULL AND product <> winner THEN 'superseded_same_datastrip'
    ELSE pair_status END AS status FROM pairs LEFT JOIN w USING (c1_item)""")
def _(spark, sf):
    return pr.products_by_item(
        two_hop(spark, sf), product="product", generation="generation", complete=F.col("k") % 8 != 0
    )


@query("latest_created_item", "D05", """WITH i AS (SELECT l_orderkey AS k,
  CASE WHEN l_linenumber = 7 THEN '' ELSE strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') END AS created, l_partkey * 1000 + l_suppkey AS item FROM lineitem)
SELECT k, arg_max(item, (created, item)) AS item, count(*) AS candidates FROM i GROUP BY ALL""")
def _(spark, sf):
    i = load(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("k"),
        F.when(F.col("l_linenumber") != 7, F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")).alias("created"),
        (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("id"),
    )
    return pr.latest_created(i, ["k"], created="created", item="id")


@query("item_per_copy", "D06 C10", """WITH i AS (SELECT l_orderkey AS k, l_linestatus AS copy, l_linenumber AS uri, l_partkey AS item FROM lineitem),
a AS (SELECT k, uri, min(item) AS a FROM i WHERE copy = 'O' GROUP BY ALL), b AS (SELECT k, uri, min(item) AS b FROM i WHERE copy = 'F' GROUP BY ALL),
m AS (SELECT k, uri, a, b FROM a FULL JOIN b USING (k, uri)),
s AS (SELECT k, min(uri) FILTER (a IS NOT NULL AND b IS NOT NULL) AS u, min(a) AS a0, min(b) AS b0 FROM m GROUP BY k)
SELECT s.k, CASE WHEN u IS NULL THEN a0 ELSE m.a END AS first_item, CASE WHEN u IS NULL THEN b0 ELSE m.b END AS second_item,
  CASE WHEN u IS NULL THEN 'no shared product' ELSE 'shared product ' || u END AS note, u IS NOT NULL AS shared
FROM s LEFT JOIN m ON s.k = m.k AND s.u = m.uri""")
def _(spark, sf):
    i = load(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linestatus").alias("copy"), F.col("l_linenumber").alias("uri"), F.col("l_partkey").alias("item")
    )
    out = pr.pair_copies(i, copy="copy", copies=("O", "F"), uri="uri", item="item", keys=["k"])
    return out.withColumn("shared", F.col("note").startswith("shared product"))


SCENES = """WITH o AS (SELECT l_orderkey AS product, l_linenumber AS layer, l_partkey AS obj, CAST(l_quantity AS BIGINT) AS size,
  strftime(l_shipdate, '%Y-%m-%d') AS modified FROM lineitem),
one AS (SELECT product, layer, max((obj, size, modified)) AS o, min(modified) AS a, max(modified) AS b, count(*) AS n FROM o GROUP BY ALL),
scenes AS (SELECT product, string_agg(layer || ':' || o[1], ',' ORDER BY layer) AS layers, min(a) AS published_at, max(b) AS last_modified,
  CAST(sum(n) AS BIGINT) AS objects, CAST(sum(o[2]) AS BIGINT) AS bytes,
  count(*) FILTER (layer IN (1, 2, 3)) = 3 AS complete,
  concat_ws(',', CASE WHEN count(*) FILTER (layer = 1) = 0 THEN '1' END, CASE WHEN count(*) FILTER (layer = 2) = 0 THEN '2' END,
    CASE WHEN count(*) FILTER (layer = 3) = 0 THEN '3' END) AS missing FROM one GROUP BY product)"""


def scenes(spark, sf):
    o = load(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("product"), F.col("l_linenumber").alias("layer"), F.col("l_partkey").alias("obj"),
        F.col("l_quantity").cast("bigint").alias("size"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("modified"),
    )
    return pr.group_scenes(o, ["product"], layer="layer", obj="obj", size="size", modified="modified")


@query("scenes_from_objects", "F01 F02 C09", SCENES + " SELECT * FROM scenes")
def _(spark, sf):
    s = scenes(spark, sf)
    text = F.transform(F.map_entries("layers"), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"]["obj"].cast("string")))
    return s.select(
        "product", F.array_join(text, ",").alias("layers"), "published_at", "last_modified", "objects", "bytes",
        pr.is_complete(F.col("layers"), [1, 2, 3]).alias("complete"),
        F.array_join(pr.missing_layers(F.col("layers"), [1, 2, 3]).cast("array<string>"), ",").alias("missing"),
    )


MONTHLY = f"""WITH {PRODUCTS}, s AS (SELECT tile, strftime(sensing_ts, '%Y-%m') AS month, strftime(sensing_ts, '%Y%m%d') AS sensing,
  generation, product, k % 4 <> 0 AS complete FROM products),
f AS (SELECT tile, month, min(sensing) AS first FROM s WHERE complete GROUP BY ALL)"""


@query("first_complete_scene_by_month", "W01", MONTHLY + """
SELECT s.tile, s.month, count(*) AS listed, count(*) FILTER (NOT complete) AS incomplete,
  arg_max(product, (generation, product)) FILTER (complete AND sensing = first) AS chosen,
  greatest(count(*) FILTER (complete AND sensing = first) - 1, 0) AS same_sensing
FROM s LEFT JOIN f USING (tile, month) GROUP BY ALL""")
def _(spark, sf):
    s = products(spark, sf).select(
        "tile", F.date_format("sensing_ts", "yyyy-MM").alias("month"), F.date_format("sensing_ts", "yyyyMMdd").alias("day"), "generation", "product", "k"
    )
    return pr.first_complete_per_month(
        s, ["tile", "month"], sensing="day", generation="generation", product="product", complete=F.col("k") % 4 != 0
    )


@query("first_sensing_by_month", "W04", MONTHLY + """, r AS (SELECT *, rank() OVER (PARTITION BY tile, month ORDER BY sensing) AS rk FROM s)
SELECT tile, month, sensing, product FROM r WHERE rk = 1""")
def _(spark, sf):
    s = products(spark, sf).select(
        "tile", F.date_format("sensing_ts", "yyyy-MM").alias("month"), F.date_format("sensing_ts", "yyyyMMdd").alias("sensing"), "product"
    )
    return pr.first_sensing(s, ["tile", "month"], "sensing")


COVERING = """WITH n AS (SELECT l_orderkey AS k, count(DISTINCT l_suppkey) AS covered FROM lineitem GROUP BY ALL),
c AS (SELECT o_custkey % 25 AS tile, o_orderkey AS item, covered, CASE WHEN o_orderkey % 6 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) % 101 END AS cloud,
  o_orderdate AS created FROM orders JOIN n ON o_orderkey = k)"""


@query("best_covering_item", "W05 W06", COVERING + """, r AS (SELECT *, count(*) OVER (PARTITION BY tile) AS candidates,
  row_number() OVER (PARTITION BY tile ORDER BY covered DESC, cloud ASC NULLS LAST, created DESC, item DESC) AS rn FROM c)
SELECT tile, item, covered, cloud, candidates FROM r WHERE rn = 1""")
def _(spark, sf):
    n = load(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").distinct().groupBy(
        F.col("l_orderkey").alias("o_orderkey")
    ).agg(F.count(F.lit(1)).alias("covered"))
    o = load(spark, sf, "orders").select(
        "o_orderkey", (F.col("o_custkey") % 25).alias("tile"), F.col("o_orderdate").alias("created"),
        F.when(F.col("o_orderkey") % 6 != 0, F.floor("o_totalprice") % 101).alias("cloud"),
    )
    c = o.join(n, "o_orderkey").withColumnRenamed("o_orderkey", "item")
    return pr.best_covering_item(c, ["tile"], covered="covered", cloud="cloud", created=F.col("created"), item="item")


@query("tile_with_most_members", "W06", """WITH m AS (SELECT o_custkey % 5 AS region, o_custkey % 25 AS tile, count(*) AS members, sum(o_orderkey % 100) AS share
  FROM orders GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY members DESC, share DESC, tile) AS rn FROM m)
SELECT region, tile, members, CAST(share AS BIGINT) AS share FROM r WHERE rn = 1""")
def _(spark, sf):
    m = load(spark, sf, "orders").groupBy((F.col("o_custkey") % 5).alias("region"), (F.col("o_custkey") % 25).alias("tile")).agg(
        F.count(F.lit(1)).alias("members"), F.sum(F.col("o_orderkey") % 100).alias("share")
    )
    order = F.struct("members", "share", -F.col("tile"))
    return m.groupBy("region").agg(F.max_by(F.struct("tile", "members", "share"), order).alias("b")).select("region", "b.*")


@query("merged_tile_members", "D25", """SELECT l_linenumber AS tile, l_partkey AS member, min(l_suppkey) AS region, count(*) AS choices
FROM lineitem GROUP BY ALL""")
def _(spark, sf):
    li = load(spark, sf, "lineitem").select(
        F.col("l_linenumber").alias("tile"), F.col("l_partkey").alias("member"), F.col("l_suppkey").alias("region")
    )
    return pr.merge_choices(li, ["tile"], "member", "region")


# ------------------------------------------------------------------ latency

CLOCKS = ("publication", "bucket_first", "bucket_last")
LATENCY = """WITH folders AS (SELECT l_orderkey AS k, min(l_shipdate) AS first, max(l_shipdate) AS last, count(*) AS objects FROM lineitem GROUP BY ALL),
items AS (SELECT o_orderkey AS k, o_custkey % 25 AS tile, o_orderdate AS sensing, strftime(o_orderdate, '%Y-%m') AS month,
  CASE WHEN o_orderkey % 9 <> 0 THEN o_orderdate + to_hours(CAST(o_orderkey % 480 AS BIGINT)) END AS publication,
  f.first AS bucket_first, f.last AS bucket_last, coalesce(f.objects, 0) AS objects FROM orders LEFT JOIN folders f ON o_orderkey = f.k),
hours AS (SELECT *, CASE WHEN publication IS NOT NULL THEN date_diff('second', sensing, publication) / 3600e0 END AS publication_hours,
  date_diff('second', sensing, bucket_first) / 3600e0 AS bucket_first_hours, date_diff('second', sensing, bucket_last) / 3600e0 AS bucket_last_hours FROM items),
rows AS (SELECT k, tile, month, 'publication' AS clock, publication_hours AS hours FROM hours WHERE publication_hours IS NOT NULL
  UNION ALL SELECT k, tile, month, 'bucket_first', bucket_first_hours FROM hours WHERE bucket_first_hours IS NOT NULL
  UNION ALL SELECT k, tile, month, 'bucket_last', bucket_last_hours FROM hours WHERE bucket_last_hours IS NOT NULL)"""
STATS = """count(*) AS n, round_even(quantile_disc(hours, 0.1) / 24, 2) AS p10, round_even(quantile_disc(hours, 0.5) / 24, 2) AS median,
  round_even(quantile_disc(hours, 0.9) / 24, 2) AS p90, round_even(quantile_disc(hours, 0.99) / 24, 2) AS p99,
  round_even(min(hours) / 24, 2) AS min, round_even(max(hours) / 24, 2) AS max"""


def items_with_clocks(spark, sf):
    found = lat.folders(
        load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), "l_shipdate"), "k", "l_shipdate"
    )
    o = load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 25).alias("tile"), F.col("o_orderdate").alias("sensing"),
        F.date_format("o_orderdate", "yyyy-MM").alias("month"),
        F.expr("CASE WHEN o_orderkey % 9 <> 0 THEN o_orderdate + make_dt_interval(0, cast(o_orderkey % 480 AS int), 0, 0) END").alias("publication"),
    )
    joined = o.join(found, "k", "left").select(
        "k", "tile", "sensing", "month", "publication", F.col("first").alias("bucket_first"), F.col("last").alias("bucket_last"),
        F.coalesce("objects", F.lit(0)).alias("objects"),
    )
    return lat.clock_hours(joined, "sensing", CLOCKS)


@query("item_clock_hours", "D08 D09 B19", LATENCY + " SELECT k, objects, publication_hours, bucket_first_hours, bucket_last_hours FROM hours")
def _(spark, sf):
    return items_with_clocks(spark, sf).select("k", "objects", *[f"{c}_hours" for c in CLOCKS])


@query("latency_by_clock", "F05 F06 F16 F18", LATENCY + f" SELECT clock, {STATS} FROM rows GROUP BY clock")
def _(spark, sf):
    rows = lat.clocks_to_rows(items_with_clocks(spark, sf), [], CLOCKS)
    return lat.latency_stats(rows, ["clock"], "hours")


@query("latency_by_sensing_month", "F18 F16", LATENCY + f" SELECT month, {STATS} FROM rows WHERE clock = 'bucket_first' GROUP BY month")
def _(spark, sf):
    rows = items_with_clocks(spark, sf).select("month", F.col("bucket_first_hours").alias("hours"))
    return lat.latency_stats(rows, ["month"], "hours")


@query("latency_by_tile_and_all", "F20 F89", LATENCY + f""", s AS (SELECT 'all' AS "group", clock, hours FROM rows
  UNION ALL SELECT CAST(tile AS VARCHAR), clock, hours FROM rows) SELECT "group", clock, {STATS} FROM s GROUP BY ALL""")
def _(spark, sf):
    rows = lat.clocks_to_rows(items_with_clocks(spark, sf), ["tile"], CLOCKS)
    groups = F.explode(F.array(F.lit("all"), F.col("tile").cast("string"))).alias("group")
    return lat.latency_stats(rows.select(groups, "clock", "hours"), ["group", "clock"], "hours")


@query("latency_before_cutoff", "F18", LATENCY + f""" SELECT tile, {STATS.replace('hours', 'bucket_first_hours')} FROM hours
WHERE bucket_first <= TIMESTAMP '1999-06-30' GROUP BY tile""")
def _(spark, sf):
    rows = items_with_clocks(spark, sf).where(F.col("bucket_first") <= F.lit("1999-06-30").cast("timestamp_ntz"))
    return lat.latency_stats(rows, ["tile"], "bucket_first_hours")


@query("share_within_hours", "F17", LATENCY + """, first AS (SELECT tile, k, min(bucket_first_hours) AS h FROM hours WHERE publication IS NOT NULL GROUP BY ALL)
SELECT tile, count(*) AS products, round_even(count(*) FILTER (h <= 6) / CAST(count(*) AS DOUBLE), 4) AS within_6h, round_even(count(*) FILTER (h <= 12) / CAST(count(*) AS DOUBLE), 4) AS within_12h,
  round_even(count(*) FILTER (h <= 24) / CAST(count(*) AS DOUBLE), 4) AS within_24h, round_even(count(*) FILTER (h <= 72) / CAST(count(*) AS DOUBLE), 4) AS within_72h FROM first GROUP BY tile""")
def _(spark, sf):
    first = items_with_clocks(spark, sf).where("publication is not null").groupBy("tile", "k").agg(F.min("bucket_first_hours").alias("h"))
    shares = lat.within(first, ["tile"], "h", F.count(F.lit(1)))
    return shares.join(first.groupBy("tile").agg(F.count(F.lit(1)).alias("products")), "tile")


@query("slowest_items", "F18", LATENCY + """ SELECT k, round_even(bucket_first_hours / 24, 2) AS bucket_first_days, round_even(publication_hours / 24, 2) AS publication_days
FROM hours WHERE bucket_first_hours IS NOT NULL ORDER BY bucket_first_hours DESC, k LIMIT 15""")
def _(spark, sf):
    h = items_with_clocks(spark, sf).where("bucket_first_hours is not null")
    top = h.orderBy(F.desc("bucket_first_hours"), "k").limit(lat.SLOWEST)
    return top.select(
        "k", sc.rounded(F.col("bucket_first_hours") / 24, 2).alias("bucket_first_days"), sc.rounded(F.col("publication_hours") / 24, 2).alias("publication_days")
    )


@query("archive_product_status", "D10 F19", f"""WITH {PRODUCTS}, items AS (SELECT product AS name, tile || platform || sensing AS pass_key FROM products WHERE k % 3 = 0),
archive AS (SELECT k, CASE WHEN k % 6 = 0 THEN product || 'X' ELSE product END AS name, tile || platform || sensing AS pass_key FROM products)
SELECT k, CASE WHEN EXISTS (SELECT 1 FROM items i WHERE i.name = a.name) THEN 'same_product'
  WHEN EXISTS (SELECT 1 FROM items i WHERE i.pass_key = a.pass_key) THEN 'pass_other_product' ELSE 'absent' END AS status FROM archive a""")
def _(spark, sf):
    p = products(spark, sf).select("k", "product", F.concat("tile", "platform", "sensing").alias("pass_key"))
    items = p.where(F.col("k") % 3 == 0).select(F.col("product").alias("name"), "pass_key")
    name = F.when(F.col("k") % 6 == 0, F.concat("product", F.lit("X"))).otherwise(F.col("product"))
    archive = p.select("k", name.alias("name"), "pass_key")
    return lat.archive_status(archive, items, name="name", pass_key="pass_key").select("k", "status")


@query("orphan_folders_and_outside_window", "F19 B24", LATENCY + """ SELECT tile, count(*) AS items, count(*) FILTER (month < '1996-01' OR month > '2000-12') AS outside,
  count(*) FILTER (objects = 0) AS without_objects FROM hours GROUP BY tile""")
def _(spark, sf):
    from tarnscope.functions.scalars import in_window

    h = items_with_clocks(spark, sf)
    inside = in_window(F.col("sensing"), F.lit("1996-01-01").cast("date"), F.lit("2000-12-31").cast("date"))
    return h.groupBy("tile").agg(
        F.count(F.lit(1)).alias("items"), F.count_if(~inside).alias("outside"), F.count_if(F.col("objects") == 0).alias("without_objects")
    )
