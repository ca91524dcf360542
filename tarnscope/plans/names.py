"""Name, date, flag and settings expressions over orders, suppliers and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnscope.functions import names as nm
from tarnscope.functions import scalars as sc
from tarnscope.plans.derived import PRODUCTS, products
from tarnscope.plans.registry import load, query

LAYER_SQL = "['B01','B02','B03','B04','B05','B06','B07','B08','B8A','B11','B12','NDWI','l2_flags','settings']"

KEYS = f"""WITH {PRODUCTS}, keys AS (
  SELECT k, 'version_01/T' || tile || '/' || product || '_' || {LAYER_SQL}[CAST(k % 14 AS INT) + 1]
    || CASE WHEN k % 11 = 0 THEN '.jpg' WHEN k % 14 = 13 THEN '.txt' ELSE '.tif' END AS key, *
  FROM products)"""


def object_keys(spark, sf):
    p = products(spark, sf)
    layers = F.array(*[F.lit(x) for x in nm.LAYERS])
    layer = F.element_at(layers, (F.col("k") % 14 + 1).cast("int"))
    ext = F.when(F.col("k") % 11 == 0, ".jpg").when(F.col("k") % 14 == 13, ".txt").otherwise(".tif")
    return p.withColumn(
        "key",
        F.concat(F.lit("version_01/T"), "tile", F.lit("/"), "product", F.lit("_"), layer, ext),
    )


@query("object_key_fields", "B01 B03 B04", KEYS + """
SELECT k, CASE WHEN k % 11 <> 0 THEN 'version_01' END AS version,
  CASE WHEN k % 11 <> 0 THEN tile END AS prefix_tile, CASE WHEN k % 11 <> 0 THEN tile END AS tile,
  CASE WHEN k % 11 <> 0 THEN platform END AS platform, CASE WHEN k % 11 <> 0 THEN sensing END AS sensing,
  CASE WHEN k % 11 <> 0 THEN strftime(sensing_ts, '%Y-%m-%dT%H:%M:%SZ') END AS sensing_time,
  CASE WHEN k % 11 <> 0 THEN substr(baseline4, 1, 2) || '.' || substr(baseline4, 3, 2) END AS baseline,
  CASE WHEN k % 11 <> 0 THEN k % 143 + 1 END AS orbit,
  CASE WHEN k % 11 <> 0 THEN strftime(generation_ts, '%Y-%m-%dT%H:%M:%SZ') END AS generation_time,
  CASE WHEN k % 11 <> 0 THEN """ + LAYER_SQL + """[CAST(k % 14 AS INT) + 1] END AS layer,
  CASE WHEN k % 11 <> 0 THEN right(key, 3) END AS extension,
  CASE WHEN k % 11 <> 0 THEN product END AS product FROM keys""")
def _(spark, sf):
    keys = object_keys(spark, sf).select("k", nm.key_parts(F.col("key")).alias("parts"))
    return keys.select("k", *[c.alias(n) for n, c in nm.parse_key(F.col("parts")).items()])


@query("product_name_fields", "B02 B05 B14 B15 B16 B17", f"""WITH {PRODUCTS}
SELECT k, CASE WHEN k % 7 <> 0 THEN platform END AS platform,
  CASE WHEN k % 7 <> 0 THEN 'L1C' END AS level, CASE WHEN k % 7 <> 0 THEN sensing END AS sensing,
  CASE WHEN k % 7 <> 0 THEN substr(baseline4, 1, 2) || '.' || substr(baseline4, 3, 2) END AS baseline,
  CASE WHEN k % 7 <> 0 THEN k % 143 + 1 END AS orbit, CASE WHEN k % 7 <> 0 THEN tile END AS tile,
  CASE WHEN k % 7 <> 0 THEN strftime(generation_ts, '%Y-%m-%dT%H:%M:%SZ') END AS generation_time,
  CASE WHEN k % 7 <> 0 THEN strftime(sensing_ts, '%Y-%m-%dT%H:%M:%SZ') END AS sensing_time,
  CASE WHEN k % 7 <> 0 THEN tile || '/' || platform || '/' || sensing END AS pass_key,
  strftime(sensing_ts, '%Y-%m-%d') || '/' || lower(letter) AS acquisition
FROM products""")
def _(spark, sf):
    name = F.concat(nm.l1c_name(F.col("product")), F.when(F.col("k") % 7 == 0, ".zip").when(F.col("k") % 2 == 0, ".SAFE").otherwise(""))
    p = products(spark, sf).select("k", "platform", "sensing", nm.product_parts(name).alias("parts"))
    fields = nm.product_fields(F.col("parts"))
    return p.select(
        "k",
        *[c.alias(n) for n, c in fields.items()],
        nm.pass_key(F.col("parts")).alias("pass_key"),
        nm.acquisition_key(F.col("platform"), F.col("sensing")).alias("acquisition"),
    )


@query("catalog_item_keys", "B06 B07 B08 B09 B10 B11 B12 B13 B54 B66 B67", f"""WITH {PRODUCTS}
SELECT k,
  CASE WHEN letter = 'D' THEN '?' ELSE lower(letter) END AS letter,
  strftime(sensing_ts, '%Y-%m-%d') || '/' || CASE WHEN letter = 'D' THEN '?' ELSE lower(letter) END AS sensing_key,
  CASE WHEN k % 3 = 0 THEN short_tile ELSE tile END AS survey_tile,
  CASE WHEN k % 5 = 0 THEN NULL ELSE tile END AS grid_tile,
  CASE WHEN k % 5 = 0 THEN 'bad' ELSE tile END AS padded_tile,
  CASE WHEN k % 4 = 0 THEN NULL ELSE sensing END AS datastrip_sensing,
  platform AS platform_code,
  tile || '/' || platform || '/' || CASE WHEN k % 4 = 0 THEN '' ELSE sensing END AS item_key,
  'GS' || CAST(k % 9 AS VARCHAR) || '|' || tile || '|' || CASE WHEN k % 4 = 0 THEN CAST(k AS VARCHAR)
     ELSE 'DS_S' || sensing || '_N02.07' END AS identity,
  'region' || CAST(k % 6 AS VARCHAR) || '-' || CAST(k AS VARCHAR) AS scene
FROM products""")
def _(spark, sf):
    p = products(spark, sf)
    k = F.col("k")
    item_id = F.concat(F.lit("S2"), "letter", F.lit("_T"), "tile", F.lit("_"), "sensing")
    p = p.select(
        "k", "letter", "tile", "sensing", "sensing_ts", item_id.alias("id"),
        F.when(k % 2 == 0, F.concat(F.lit("sentinel-2"), F.lower("letter"))).alias("platform"),
        F.concat(F.lit("sentinel-2"), F.lower("letter")).alias("full_platform"),
        F.when(k % 3 == 0, F.concat(F.lit("MGRS-"), "short_tile")).alias("grid_code"),
        F.when(k % 5 == 0, F.lit("bad")).otherwise(F.concat(F.lit("MGRS-"), "short_tile")).alias("any_code"),
        F.when(k % 4 != 0, F.concat(F.lit("DS_S"), "sensing", F.lit("_N02.07"))).alias("datastrip"),
    )
    letter = nm.platform_letter(F.coalesce("platform", F.lit("")), F.col("id"))
    strip = nm.datastrip_sensing(F.col("datastrip"))
    code = nm.platform_code(F.col("full_platform"))
    return p.select(
        "k",
        letter.alias("letter"),
        nm.item_sensing_key(F.date_format("sensing_ts", "yyyy-MM-dd'T'HH:mm:ss"), letter).alias("sensing_key"),
        nm.tile_code(F.col("grid_code"), F.col("id")).alias("survey_tile"),
        nm.normalize_grid_code(F.col("any_code")).alias("grid_tile"),
        nm.normalize_tile(F.col("any_code")).alias("padded_tile"),
        strip.alias("datastrip_sensing"),
        code.alias("platform_code"),
        F.concat(F.col("tile"), F.lit("/"), code, F.lit("/"), F.coalesce(strip, F.lit(""))).alias("item_key"),
        nm.observation_identity(
            F.concat(F.lit("GS"), (k % 9).cast("string")), F.col("tile"), F.col("datastrip"), k.cast("string")
        ).alias("identity"),
        nm.scene_id(F.concat(F.lit("region"), (k % 6).cast("string")), k.cast("string")).alias("scene"),
    )


@query("dates_and_windows", "B18 B19 B20 B22 B23 B24 B25 B39 B55", f"""WITH {PRODUCTS}
SELECT k, CAST(k % 97 AS DOUBLE) AS hours, CASE WHEN k % 6 <> 0 THEN CAST(k % 97 AS DOUBLE) END AS hours_or_none, round_even(k % 40 * 450 / 3600e0, 2) AS hours_at_ties,
  epoch(sensing_ts) AS epoch_seconds,
  strftime(sensing_ts, '%Y-%m-01') AS month_first,
  strftime(last_day(CAST(sensing_ts AS DATE)), '%Y-%m-%d') AS month_last,
  sensing_ts >= TIMESTAMP '1996-03-01' AND sensing_ts < TIMESTAMP '1999-04-01' AS in_window,
  CAST(CAST(substr(tile, 1, 2) AS INT) AS VARCHAR) || '/S/GJ' AS tile_prefix,
  strftime(generation_ts, '%Y-%m-%d') AS feature_date,
  'https://store.example/version_01/T' || tile || '/' || product || '%20copy.tif' AS url
FROM products""")
def _(spark, sf):
    p = products(spark, sf)
    first, last = sc.month_bounds(F.to_date("sensing_ts"))
    zoned = F.date_format("sensing_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    key = F.concat(F.lit("version_01/T"), "tile", F.lit("/"), "product", F.lit(" copy.tif"))
    return p.select(
        "k",
        sc.hours_between(F.col("sensing_ts"), F.col("generation_ts")).alias("hours"),
        sc.hours_between(F.col("sensing_ts"), F.when(F.col("k") % 6 != 0, F.col("generation_ts"))).alias("hours_or_none"),
        sc.hours_between(F.col("sensing_ts"), F.col("sensing_ts") + F.make_dt_interval(secs=F.col("k") % 40 * 450)).alias("hours_at_ties"),
        sc.epoch_seconds(zoned, optional=True).alias("epoch_seconds"),
        F.date_format(first, "yyyy-MM-dd").alias("month_first"),
        F.date_format(last, "yyyy-MM-dd").alias("month_last"),
        sc.in_window(F.col("sensing_ts"), F.lit("1996-03-01").cast("date"), F.lit("1999-03-31").cast("date")).alias("in_window"),
        nm.tile_prefix(F.col("tile")).alias("tile_prefix"),
        F.date_format(
            sc.feature_date(F.unix_millis(F.col("generation_ts").cast("timestamp"))), "yyyy-MM-dd"
        ).alias("feature_date"),
        nm.object_url(F.lit("https://store.example"), key).alias("url"),
    )


@query("month_prefix_list", "B21 B26 C20", """WITH spans AS (
  SELECT o_custkey AS c, date_trunc('month', min(o_orderdate)) AS a, date_trunc('month', max(o_orderdate)) AS b
  FROM orders GROUP BY 1), months AS (
  SELECT c, unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS m FROM spans)
SELECT c, strftime(m, '%Y-%m') AS month,
  'tiles/' || CAST(c % 25 + 1 AS VARCHAR) || '/S/GJ/' || CAST(year(m) AS VARCHAR) || '/' || CAST(month(m) AS VARCHAR) || '/' AS prefix
FROM months""")
def _(spark, sf):
    o = load(spark, sf, "orders")
    spans = o.groupBy(F.col("o_custkey").alias("c")).agg(
        F.to_date(F.min("o_orderdate")).alias("a"), F.to_date(F.max("o_orderdate")).alias("b")
    )
    tile = F.concat(F.lpad((F.col("c") % 25 + 1).cast("string"), 2, "0"), F.lit("SGJ"))
    months = spans.select("c", F.explode(sc.month_list(F.col("a"), F.col("b"))).alias("m"))
    return months.select(
        "c",
        nm.parse_month(sc.month_text(F.col("m"))).alias("month"),
        nm.month_prefix(F.lit("tiles"), tile, F.col("m")).alias("prefix"),
    )


@query("scene_spec_fields", "C18", f"""WITH {PRODUCTS}
SELECT k, tile, strftime(sensing_ts, '%Y-%m') AS month,
  CASE WHEN k % 2 = 0 THEN strftime(sensing_ts, '%d') END AS day FROM products""")
def _(spark, sf):
    p = products(spark, sf)
    pattern = F.when(F.col("k") % 2 == 0, F.date_format("sensing_ts", "yyyy-MM-dd")).otherwise(
        F.date_format("sensing_ts", "yyyy-MM")
    )
    spec = F.concat(F.col("tile"), F.lit(":"), pattern)
    return p.select("k", *[c.alias(n) for n, c in nm.parse_scene_spec(spec).items()])


@query("body_classes", "B27 B36 B37 B38 B40 B41 B42 B61 C01 C02", """
SELECT s_suppkey,
  CAST(CASE WHEN w < 14.142135623730951 THEN 10 WHEN w < 31.622776601683793 THEN 20
    WHEN w < 70.71067811865476 THEN 50 ELSE 100 END AS BIGINT) AS size_class,
  CASE WHEN s_suppkey % 9 = 0 THEN 'anchor' ELSE CAST(CASE WHEN w < 14.142135623730951 THEN 10
    WHEN w < 31.622776601683793 THEN 20 WHEN w < 70.71067811865476 THEN 50 ELSE 100 END AS VARCHAR) || ' m' END AS size_label,
  CASE WHEN area < 100000 THEN 'small' WHEN area < 1000000 THEN 'medium' ELSE 'large' END AS area_band,
  CASE WHEN cover < 20 THEN '0-20' WHEN cover < 40 THEN '20-40' WHEN cover < 60 THEN '40-60'
    WHEN cover < 80 THEN '60-80' ELSE '80-100' END AS cloud_bin,
  'nhd-ab' || CAST(s_suppkey AS VARCHAR) AS body,
  sha256('20260916:{AB' || CAST(s_suppkey AS VARCHAR) || '}') AS order_key,
  (x >= 5 AND x < 20 AND y >= 2 AND y < 9) AS in_box
FROM (SELECT *, s_suppkey * 13 % 150 + 1 AS w, abs(s_acctbal) * 200 AS area, s_suppkey * 7 % 101 AS cover,
  s_nationkey AS x, s_suppkey % 11 AS y FROM supplier)
WHERE s_suppkey % 4 <> 3 AND area >= 1""")
def _(spark, sf):
    from tarnscope.operators.selection import eligible_bodies, inside_box

    s = load(spark, sf, "supplier")
    k = F.col("s_suppkey")
    source = F.concat(F.lit("{AB"), k.cast("string"), F.lit("}"))
    s = s.select(
        "s_suppkey",
        source.alias("source_id"),
        (k * 13 % 150 + 1).alias("w"),
        (F.abs("s_acctbal") * 200).alias("area"),
        (k * 7 % 101).alias("cover"),
        F.col("s_nationkey").alias("x"),
        (k % 11).alias("y"),
        F.element_at(F.array(*[F.lit(c) for c in (390, 436, 493, 361)]), (k % 4 + 1).cast("int")).alias("ftype"),
        F.lit("Polygon").alias("kind"),
    )
    s = eligible_bodies(s, code="ftype", kind="kind", source_id="source_id", area="area", codes=(390, 436, 493))
    size = sc.size_class(F.col("w"), [10, 20, 50, 100])
    tier = F.when(k % 9 == 0, "large").otherwise("size_class")
    return s.select(
        "s_suppkey",
        size.cast("bigint").alias("size_class"),
        sc.size_label(tier, size).alias("size_label"),
        sc.area_band(F.col("area")).alias("area_band"),
        sc.cloud_bin(F.col("cover")).alias("cloud_bin"),
        nm.water_body_id(F.col("source_id")).alias("body"),
        sc.stable_key(F.col("source_id"), "20260916").alias("order_key"),
        inside_box("x", "y", (5, 2, 20, 9)).alias("in_box"),
    )


@query("flag_bits", "B28 B29", """WITH f AS (
  SELECT event_id, CASE WHEN event_id % 17 = 0 THEN -32768 WHEN event_id % 13 = 0 THEN event_id % 32 * 10000 + 7
    WHEN event_id % 19 = 0 THEN -(event_id % 32) * 10000 ELSE event_id % 32 * 10000 END AS flags FROM events)
SELECT event_id, CASE WHEN flags = -32768 OR flags % 10000 <> 0 THEN 0 ELSE CAST(floor(flags / 10000) AS BIGINT) END AS decoded,
  flags = -32768 AS flags_missing, flags <> -32768 AND flags % 10000 <> 0 AS not_multiple,
  '0:cloud,2:swir,4:' || CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END AS exponents
FROM f""")
def _(spark, sf):
    e = load(spark, sf, "events")
    i = F.col("event_id")
    flags = (
        F.when(i % 17 == 0, F.lit(-32768))
        .when(i % 13 == 0, i % 32 * 10000 + 7)
        .when(i % 19 == 0, -(i % 32) * 10000)
        .otherwise(i % 32 * 10000)
    )
    settings = F.create_map(
        F.lit("flag_exponent_swir"), F.lit("2"),
        F.concat(F.lit("flag_exponent_"), F.when(i % 2 == 0, "even").otherwise("odd")), F.lit("4"),
        F.lit("flag_exponent_cloud"), F.lit("0"),
        F.lit("flag_exponent_bad"), F.lit("x"),
        F.lit("limit"), F.lit("3"),
    )
    e = e.select("event_id", flags.alias("flags"), sc.flag_exponents(settings).alias("exp"))
    text = F.array_join(F.transform("exp", lambda p: F.concat(p["bit"].cast("string"), F.lit(":"), p["flag"])), ",")
    return e.select(
        "event_id", *[c.alias(n) for n, c in sc.decode_flags(F.col("flags")).items()], text.alias("exponents")
    )


@query("pixel_scalars", "B30 B31 B33 B34 B35 B50 B52 B64 T09", """WITH p AS (
  SELECT l_orderkey AS a, l_partkey AS b, l_suppkey AS s, l_linenumber AS n,
    l_partkey % 3000 AS g, l_orderkey % 2500 AS r, l_orderkey % 5 AS q, l_partkey % 400 AS cnt, l_orderkey % 90 AS dis
  FROM lineitem)
SELECT a, b, s, n,
  round_even(q / CASE WHEN n = 4 THEN NULL ELSE CAST(n AS DOUBLE) END, 6) AS share,
  (g + r - 1 > 0) AS comparable,
  CASE WHEN cnt < 100 THEN 'too_few' WHEN 1 - dis / CAST(cnt AS DOUBLE) >= 9e-1 THEN 'agree' ELSE 'differs' END AS verdict,
  CASE WHEN s % 10 = 0 THEN NULL WHEN dis / 1e2 - q / 1e1 > 5e-2 THEN 'widens'
    WHEN q / 1e1 - dis / 1e2 > 5e-2 THEN 'narrows' ELSE 'similar' END AS widening,
  CASE WHEN cnt >= 100 AND r > 50 THEN round_even((g - r) / CAST(r AS DOUBLE), 4) END AS relative_offset,
  CASE WHEN n % 3 = 0 THEN 'xyz' WHEN n % 3 = 1 THEN 'yzx' ELSE 'zxy' END AS rotated,
  CASE WHEN b % 2 = 0 THEN 32600 ELSE 32700 END + least(60, CAST(floor(((a % 360 - 180) + 180) / 6) AS BIGINT) + 1) AS epsg,
  CASE WHEN g <> 0 THEN round(g * 1e-4 - 1e-1, 6) END AS reflectance,
  CASE WHEN g + r <> 0 THEN round((g - r) / CAST(g + r AS DOUBLE), 6) END AS difference_index
FROM p""")
def _(spark, sf):
    li = load(spark, sf, "lineitem")
    p = li.select(
        F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b"), F.col("l_suppkey").alias("s"),
        F.col("l_linenumber").cast("bigint").alias("n"), (F.col("l_partkey") % 3000).alias("g"),
        (F.col("l_orderkey") % 2500).alias("r"), (F.col("l_orderkey") % 5).alias("q"),
        (F.col("l_partkey") % 400).alias("cnt"), (F.col("l_orderkey") % 90).alias("dis"),
    )
    n, g, r = F.col("n"), F.col("g"), F.col("r")
    comparable, _agrees = sc.ndwi_agrees(g, r, F.lit(0))
    first = F.when(F.col("s") % 10 != 0, F.col("dis") / F.lit(100.0))
    return p.select(
        "a", "b", "s", p["n"].cast("int").alias("n"),
        sc.share(F.col("q"), F.when(n == 4, F.lit(0)).otherwise(n)).alias("share"),
        comparable.alias("comparable"),
        sc.overlap_verdict(F.col("cnt"), F.col("dis")).alias("verdict"),
        sc.widening(first, F.col("q") / F.lit(10.0)).alias("widening"),
        sc.relative_offset(F.col("cnt"), g - r, r).alias("relative_offset"),
        F.array_join(sc.rotated(F.array(F.lit("x"), F.lit("y"), F.lit("z")), n.cast("int")), "").alias("rotated"),
        sc.utm_epsg(F.col("a") % 360 - 180, F.when(F.col("b") % 2 == 0, 1).otherwise(-1)).cast("bigint").alias("epsg"),
        F.round(sc.reflectance(g, F.lit(0.0001), F.lit(-0.1)), 6).alias("reflectance"),
        sc.rounded_away(sc.normalized_difference(g, r), 6).alias("difference_index"),
    )
