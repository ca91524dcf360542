"""Source queries: documents of every source format composed from orders and parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnscope.functions.scalars import flag_exponents
from tarnscope.operators import geometry as geo
from tarnscope.plans.derived import PRODUCTS, products
from tarnscope.plans.registry import load, query
from tarnscope.session import scratch_path
from tarnscope.sources import catalog as cat
from tarnscope.sources import files as fs

HOST = "public.example"


def feature_text(spark, sf):
    """A catalog feature per order as JSON text, with fields absent where a pattern says."""
    p = products(spark, sf)
    k = F.col("k")
    prop = F.struct(
        F.date_format("sensing_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("datetime"),
        F.when(k % 4 != 0, F.concat(F.lit("sentinel-2"), F.lower("letter"))).alias("platform"),
        F.when(k % 3 != 0, F.concat(F.lit("MGRS-"), "short_tile")).alias("grid:code"),
        F.when(k % 7 != 0, F.concat(F.substring("baseline4", 1, 2), F.lit("."), F.substring("baseline4", 3, 2))).alias("s2:processing_baseline"),
        F.lit("05.11").alias("processing:version"),
        (k % 2).cast("string").alias("s2:sequence"),
        F.when(k % 5 != 0, F.create_map(F.lit("sen2cor"), F.lit("2.11"))).alias("processing:software"),
        F.when(k % 6 != 0, k % 2 == 0).alias("earthsearch:boa_offset_applied"),
        (k % 101).cast("double").alias("eo:cloud_cover"),
        F.concat("product", F.lit(".SAFE")).alias("s2:product_uri"),
        F.date_format("generation_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("s2:generation_time"),
        F.lit("EPSG:32617").alias("proj:code"),
    )
    item = F.concat(F.lit("S2"), "letter", F.lit("_T"), "tile", F.lit("_"), "sensing")

    def asset(kind, res, scale):
        href = F.concat(F.lit("https://"), F.when(k % 8 == 0, "other.example").otherwise(HOST), F.lit("/a.tif"))
        shape = F.array(F.lit(109800 // res), F.lit(109800 // res))
        band = F.struct(F.lit("uint16").alias("data_type"), scale.alias("scale"), F.when(k % 2 == 0, -0.1).alias("offset"), F.lit(0.0).alias("nodata"))
        return F.struct(
            href.alias("href"), kind.alias("type"), F.array(F.lit(float(res)), F.lit(0.0), F.lit(6e5), F.lit(0.0), F.lit(-float(res)), F.lit(4e6)).alias("proj:transform"),
            shape.alias("proj:shape"), F.array(band).alias("raster:bands"),
        )

    tiff = F.lit("image/tiff; application=geotiff; profile=cloud-optimized")
    red_kind = F.when(k % 9 == 0, "image/jp2").otherwise(tiff)
    assets = F.create_map(
        F.lit("red"), asset(red_kind, 10, F.when(k % 3 != 0, 0.0001)), F.lit("scl"), asset(tiff, 20, F.lit(None).cast("double")),
        F.when(k % 2 == 0, F.lit("swir16")).otherwise("coastal"), asset(tiff, 20, F.lit(0.0001)),
    )
    body = F.struct(item.alias("id"), F.lit("sentinel-2-c1-l2a").alias("collection"), prop.alias("properties"), assets.alias("assets"))
    return p.select("k", F.to_json(body).alias("text"))


def features(spark, sf):
    return cat.features_from_text(feature_text(spark, sf), "text", ["k"])


@query("catalog_items_from_json", "A01 A24 A26 S01", f"""WITH {PRODUCTS} SELECT k, 'S2' || letter || '_T' || tile || '_' || sensing AS id, 'sentinel-2-c1-l2a' AS collection, strftime(sensing_ts, '%Y-%m-%dT%H:%M:%SZ') AS datetime,
  CASE WHEN letter = 'D' THEN '?' ELSE lower(letter) END AS platform, CASE WHEN k % 3 <> 0 THEN short_tile ELSE tile END AS tile,
  CASE WHEN k % 7 <> 0 THEN substr(baseline4, 1, 2) || '.' || substr(baseline4, 3, 2) END AS baseline, CAST(k % 2 AS VARCHAR) AS sequence,
  CASE WHEN k % 5 <> 0 THEN '{{"sen2cor":"2.11"}}' END AS software, CASE WHEN k % 6 <> 0 THEN k % 2 = 0 END AS offset_applied, CAST(k % 101 AS DOUBLE) AS cloud_cover,
  CAST(NULL AS DOUBLE) AS nodata_pct, product || '.SAFE' AS product_uri, strftime(generation_ts, '%Y-%m-%dT%H:%M:%SZ') AS generation_time, CAST(NULL AS VARCHAR) AS created FROM products""")
def _(spark, sf):
    return cat.normalize_primary(features(spark, sf), ["k"])


@query("reference_items_from_json", "A02 D39", f"""WITH {PRODUCTS} SELECT k, 'S2' || letter || '_T' || tile || '_' || sensing AS id, strftime(sensing_ts, '%Y-%m-%dT%H:%M:%SZ') AS datetime, '05.11' AS baseline,
  CAST(k % 101 AS DOUBLE) AS cloud_cover, CAST(NULL AS VARCHAR) AS sequence, CAST(NULL AS BOOLEAN) AS offset_applied FROM products""")
def _(spark, sf):
    return cat.normalize_reference(features(spark, sf), ["k"]).select("k", "id", "datetime", "baseline", "cloud_cover", "sequence", "offset_applied")


@query("asset_rows", "A03 B32 E17 B45", f"""WITH {PRODUCTS}, a AS (SELECT k, unnest(['red', 'scl', CASE WHEN k % 2 = 0 THEN 'swir16' ELSE 'coastal' END]) AS key FROM products)
SELECT k, key, CASE WHEN k % 8 = 0 THEN 'other.example' ELSE 'public.example' END AS host, CASE WHEN key = 'red' THEN 10 ELSE 20 END AS resolution, 'uint16' AS data_type,
  CASE WHEN key = 'scl' OR (key = 'red' AND k % 3 = 0) THEN 1e0 ELSE 1e-4 END AS scale, CASE WHEN k % 2 = 0 THEN -1e-1 ELSE 0e0 END AS "offset", 0e0 AS nodata FROM a""")
def _(spark, sf):
    return cat.asset_summary(features(spark, sf), ["k"]).drop("type")


@query("asset_classes", "C04 B47 C05", f"""WITH {PRODUCTS} SELECT k, CASE WHEN k % 8 = 0 THEN '' ELSE concat_ws(',', CASE WHEN k % 2 = 1 THEN 'coastal' END, CASE WHEN k % 9 <> 0 THEN 'red' END, 'scl', CASE WHEN k % 2 = 0 THEN 'swir16' END) END AS cog,
  CASE WHEN k % 9 = 0 THEN 'red' ELSE '' END AS jp2, CASE WHEN k % 8 = 0 THEN 0 WHEN k % 9 = 0 THEN 1 ELSE 2 END AS bands_cog, FALSE AS bands_complete,
  CASE WHEN k % 8 = 0 THEN 'other' ELSE 'cog' END AS quality_scl, CAST(NULL AS VARCHAR) AS quality_snow FROM products""")
def _(spark, sf):
    c = cat.classify_assets(features(spark, sf), HOST, ["k"])
    return c.select("k", F.array_join("cog_assets", ",").alias("cog"), F.array_join("jp2_assets", ",").alias("jp2"), "bands_cog", "bands_complete", "quality_scl", "quality_snow")


@query("resolved_assets", "C06 C07 B46 F53", f"""WITH {PRODUCTS}, a AS (SELECT k, unnest(['red', 'coastal']) AS key FROM products)
SELECT k, key, CASE WHEN key = 'coastal' AND k % 2 = 0 THEN 'asset missing' WHEN key = 'red' AND k % 9 = 0 THEN 'not a GeoTIFF' END AS reason,
  NOT (key = 'coastal' AND k % 2 = 0) AND NOT (key = 'red' AND k % 9 = 0) AS usable FROM a""")
def _(spark, sf):
    return cat.resolve_assets(features(spark, sf), ["red", "coastal"], ["k"])


@query("trimmed_items", "B43 B44", f"""WITH {PRODUCTS} SELECT k, CASE WHEN k % 3 <> 0 THEN 'MGRS-' || short_tile END AS grid_code, 32617 AS epsg, CAST(k % 2 AS VARCHAR) AS sequence, FALSE AS requester_pays,
  CASE WHEN k % 2 = 0 THEN 'red,scl,swir16' ELSE 'coastal,red,scl' END AS asset_keys FROM products""")
def _(spark, sf):
    t = cat.trim_item(features(spark, sf), ["k"])
    return t.select("k", "grid_code", "epsg", "sequence", "requester_pays", F.array_join("asset_keys", ",").alias("asset_keys"))


@query("stand_in_items", "D41 D35", f"""WITH {PRODUCTS} SELECT product AS id, k AS paired_item, replace(product, '_MSIAQR_', '_MSIL1C_') AS l1c_product,
  'https://store.example/version_01/T' || tile || '/' || product || '_B04.tif' AS red, k * 3 AS red_size FROM products""")
def _(spark, sf):
    p = products(spark, sf)
    key = F.concat(F.lit("version_01/T"), "tile", F.lit("/"), "product", F.lit("_B04.tif"))
    scenes = p.select("k", "product", F.create_map(F.lit("B04"), F.struct(key.alias("key"), (F.col("k") * 3).alias("size"))).alias("layers"))
    out = cat.stand_in_item(features(spark, sf).select("k", "id"), scenes, "k", {"red": "B04"}, "https://store.example")
    red = F.element_at("assets", "red")
    return out.select("id", "paired_item", "l1c_product", red["href"].alias("red"), red["size"].alias("red_size"))


@query("listing_objects", "A04 S01", """SELECT o_orderkey AS k, key, size, etag, modified AS last_modified, o_orderkey % 5 = 0 AS truncated FROM (SELECT *, unnest([
  {'key': 'p/' || o_orderkey || '/a.tif', 'size': o_custkey, 'etag': 'e' || o_orderkey, 'modified': strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ')},
  {'key': 'p/' || o_orderkey || '/b.tif', 'size': 0, 'etag': 'f', 'modified': '2020-01-01T00:00:00Z'}], recursive := true) FROM orders)""")
def _(spark, sf):
    k = F.col("o_orderkey").cast("string")
    first = F.concat(
        F.lit("<Contents><Key>p/"), k, F.lit("/a.tif</Key><LastModified>"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</LastModified><ETag>\"e"), k,
        F.lit("\"</ETag><Size>"), F.col("o_custkey").cast("string"), F.lit("</Size><StorageClass>STANDARD</StorageClass></Contents>"),
    )
    second = F.concat(F.lit("<Contents><Key>p/"), k, F.lit("/b.tif</Key><LastModified>2020-01-01T00:00:00Z</LastModified><ETag>\"f\"</ETag></Contents>"))
    page = F.concat(
        F.lit('<ListBucketResult xmlns="http://s3.amazonaws.com/doc/2006-03-01/"><IsTruncated>'), F.when(F.col("o_orderkey") % 5 == 0, "true").otherwise("false"),
        F.lit("</IsTruncated>"), first, second, F.lit("<CommonPrefixes><Prefix>p/</Prefix></CommonPrefixes></ListBucketResult>"),
    )
    pages = fs.listing_from_text(load(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), page.alias("xml")), "xml", ["k"])
    return fs.listed_objects(pages, ["k", "truncated"]).drop("storage_class")


@query("settings_values", "A05 B28", """SELECT o_orderkey AS k, key, value FROM (SELECT *, unnest([{'key': 'flag_exponent_swir', 'value': '2'}, {'key': 'limit', 'value': 'a=' || o_custkey}, {'key': 'flag_exponent_cloud', 'value': CAST(o_orderkey % 9 AS VARCHAR)}], recursive := true) FROM orders)""")
def _(spark, sf):
    k = F.col("o_orderkey")
    text = F.concat(
        F.lit("# comment\n\nflag_exponent_swir=7\n; other\n limit = a="), F.col("o_custkey").cast("string"), F.lit("\nno pair\nflag_exponent_swir = 2\nflag_exponent_cloud="),
        (k % 9).cast("string"), F.lit("\n"),
    )
    return fs.settings_lines(load(spark, sf, "orders").select(k.alias("k"), text.alias("text")), "text", ["k"])


@query("flag_table_from_settings", "B28 A05", """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 9 < 2 THEN (o_orderkey % 9) || ':cloud,2:swir' WHEN o_orderkey % 9 = 2 THEN '2:cloud,2:swir' ELSE '2:swir,' || (o_orderkey % 9) || ':cloud' END AS bits FROM orders""")
def _(spark, sf):
    k = F.col("o_orderkey")
    lines = F.concat(F.lit("flag_exponent_swir=2\nflag_exponent_bad=x\nflag_exponent_cloud="), (k % 9).cast("string"))
    settings = fs.settings_lines(load(spark, sf, "orders").select(k.alias("k"), lines.alias("text")), "text", ["k"])
    maps = settings.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("m"))
    bits = F.transform(flag_exponents(F.col("m")), lambda p: F.concat(p["bit"].cast("string"), F.lit(":"), p["flag"]))
    return maps.select("k", F.array_join(bits, ",").alias("bits"))


@query("bodies_from_geojson", "A14 A15 A16 B51 B60 E06", """SELECT 'nhd-' || s_suppkey AS site_id, 'pilot' AS "group", s_suppkey % 90 * 1e0 AS west, s_suppkey % 50 * 1e0 AS south,
  s_suppkey % 90 + 2e0 AS east, s_suppkey % 50 + 1e0 AS north, CAST(5 AS BIGINT) AS vertices, 2e0 AS area FROM supplier WHERE s_nationkey % 3 <> 1""")
def _(spark, sf):
    s = F.col("s_suppkey")
    x, y = s % 90, s % 50

    def pair(a, b):
        return F.concat(F.lit("["), a.cast("string"), F.lit(","), b.cast("string"), F.lit(",0.5]"))

    text = F.concat(F.lit("["), F.concat(F.lit("["), F.concat_ws(",", pair(x, y), pair(x + 2, y), pair(x + 2, y + 1), pair(x, y + 1), pair(x, y)), F.lit("]")), F.lit("]"))
    f = load(spark, sf, "supplier").select(
        F.struct(
            F.concat(F.lit("nhd-"), s).alias("water_body_id"), F.lit("x").alias("name"), F.concat(F.lit("r"), F.col("s_nationkey") % 3).alias("region"), F.lit("size_class").alias("tier"),
            F.lit(None).cast("string").alias("why"),
        ).alias("properties"),
        F.array(x.cast("double"), y.cast("double"), (x + 2).cast("double"), (y + 1).cast("double")).alias("bbox"),
        F.struct(F.lit("Polygon").alias("type"), text.alias("coordinates")).alias("geometry"),
    )
    b = fs.wanted_bodies(fs.bodies(f), regions=["r0", "r2"])
    rings = fs.rings_of(b, ["water_body_id"])
    rings = rings.withColumn("pts", geo.round_points(F.col("pts"), 6))
    m = geo.polygon_measures(rings, ["water_body_id"]).select(F.col("water_body_id").alias("site_id"), "area", "vertices")
    return fs.survey_sites(b).join(m, "site_id").select("site_id", "group", "west", "south", "east", "north", "vertices", "area")


@query("search_pages", "A19", """SELECT l_suppkey AS search, sha256('page' || l_orderkey || '-' || l_partkey) AS digest, count(*) AS rows FROM lineitem GROUP BY ALL""")
def _(spark, sf):
    li = load(spark, sf, "lineitem").groupBy(
        F.col("l_suppkey").alias("search"), F.sha2(F.concat(F.lit("page"), "l_orderkey", F.lit("-"), "l_partkey"), 256).alias("digest")
    ).agg(F.count(F.lit(1)).alias("rows"))
    pages = cat.pages_once(li, "search", "digest", "rows")
    return pages


@query("saved_mask_roundtrip", "A10 A11 A12 A13 E28", """SELECT 'T' || (l_suppkey % 5) AS tile_id, [10, 20, 60][l_linenumber % 3 + 1] AS resolution_m, count(*) AS pixels, count(*) * 9 AS list_bytes FROM lineitem GROUP BY ALL""")
def _(spark, sf):
    n = F.col("l_linenumber")
    m = load(spark, sf, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("body"), F.concat(F.lit("T"), F.col("l_suppkey") % 5).alias("tile_id"),
        F.element_at(F.array(F.lit(10), F.lit(20), F.lit(60)), n % 3 + 1).alias("resolution_m"), F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("col"),
        (n % 3 + 1).alias("pixel_class"), (F.col("l_quantity") / 50).alias("coverage"),
    )
    path = scratch_path(spark, "masks")
    fs.save_masks(m, path)
    return fs.mask_sizes(fs.load_masks(spark, path), ["tile_id", "resolution_m"])


@query("header_grids", "A06 A27 F41", """SELECT l_linenumber AS n, CASE WHEN l_linenumber = 7 THEN 'int32' ELSE 'int16' END AS dtype, 5490 AS rows, count(*) AS headers, count(DISTINCT l_returnflag) AS grids FROM lineitem GROUP BY ALL""")
def _(spark, sf):
    h = load(spark, sf, "lineitem").select(
        F.col("l_linenumber").alias("n"), F.when(F.col("l_linenumber") == 7, "int32").otherwise("int16").alias("dtype"), F.lit(5490).alias("rows"), F.lit(5490).alias("cols"),
        F.lit(32617).alias("epsg"), F.array(F.lit(20.0), F.lit(0.0), F.ascii("l_returnflag").cast("double")).alias("transform"),
    ).withColumn("grid", fs.header_digest())
    return h.groupBy("n", "dtype", "rows").agg(F.count(F.lit(1)).alias("headers"), F.count_distinct("grid").alias("grids"))


@query("written_result", "A09", "SELECT o_orderpriority AS priority, count(*) AS n, min(o_orderkey) AS low FROM orders GROUP BY ALL")
def _(spark, sf):
    """A result written as JSON under the commit protocol and read back with its schema."""
    out = load(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("low"))
    path = scratch_path(spark, "result")
    fs.write_result(out.where(F.lit(False)), path)
    fs.write_result(out, path)
    return spark.read.schema(out.schema).json(fs.latest_result(spark, path))
