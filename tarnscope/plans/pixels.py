"""Pixel-statistic queries: validity over events, paired values over lineitems, overlap and
resampling over embedding blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnscope.functions import scalars as sc
from tarnscope.operators import pixels as px
from tarnscope.operators.coverage import pooled
from tarnscope.operators.quantiles import linear
from tarnscope.plans.extraction import blocks
from tarnscope.plans.registry import load, query

# ------------------------------------------------------------------ validity


def validity_pixels(spark, sf):
    i = F.col("event_id")
    flags = F.when(i % 17 == 0, F.lit(-32768)).when(i % 13 == 0, i % 32 * 10000 + 7).otherwise(i % 32 * 10000)
    return load(spark, sf, "events").select(
        F.concat(F.lit("scene"), F.col("user_id") % 10).alias("scene"), (i % 3 + 1).alias("pixel_class"),
        F.when(i % 23 == 0, F.lit(-32768)).otherwise(F.floor(F.col("value") * 100) % 12000 - 500).alias("B03"),
        F.when(i % 29 == 0, F.lit(-32768)).otherwise(i * 37 % 11000 - 300).alias("B08"),
        F.when(i % 31 == 0, F.lit(-32768)).otherwise(i * 53 % 22001 - 11000).alias("ndwi"),
        flags.alias("flags"), (i % 12).alias("scl"), (F.col("user_id") % 10 != 0).alias("has_join"),
    )


VAL = """WITH v AS (SELECT 'scene' || (user_id % 10) AS scene, event_id % 3 + 1 AS pixel_class,
  CASE WHEN event_id % 23 = 0 THEN -32768 ELSE CAST(floor(value * 100) AS BIGINT) % 12000 - 500 END AS B03,
  CASE WHEN event_id % 29 = 0 THEN -32768 ELSE event_id * 37 % 11000 - 300 END AS B08,
  CASE WHEN event_id % 31 = 0 THEN -32768 ELSE event_id * 53 % 22001 - 11000 END AS ndwi,
  CASE WHEN event_id % 17 = 0 THEN -32768 WHEN event_id % 13 = 0 THEN event_id % 32 * 10000 + 7 ELSE event_id % 32 * 10000 END AS flags,
  event_id % 12 AS scl, user_id % 10 <> 0 AS has_join FROM events),
d AS (SELECT *, flags = -32768 AS fm, flags <> -32768 AND flags % 10000 <> 0 AS nm,
  CASE WHEN flags = -32768 OR flags % 10000 <> 0 THEN 0 ELSE flags // 10000 END AS dec, has_join AND scl <> 0 AS joined FROM v),
u AS (SELECT *, NOT fm AND NOT nm AS ok, joined AND ndwi <> -32768 AND NOT fm AND NOT nm AS usable FROM d)"""


def when_joined(sql: str) -> str:
    return f"CASE WHEN bool_or(has_join) THEN {sql} END"


def agree_sql(prefix: str, test: str) -> str:
    cases = {"both": f"{test} AND scl = 6", "product_only": f"{test} AND scl <> 6", "scl_only": f"NOT ({test}) AND scl = 6", "neither": f"NOT ({test}) AND scl <> 6"}
    return ", ".join(f"{when_joined(f'count(*) FILTER (usable AND {c})')} AS {prefix}_{n}" for n, c in cases.items())


VALIDITY = VAL + f""" SELECT scene, pixel_class, count(*) AS pixels, count(*) FILTER (ndwi = -32768) AS ndwi_no_data,
  count(*) FILTER (ndwi > 0) AS ndwi_positive, count(*) FILTER (ndwi = 0) AS ndwi_zero,
  count(*) FILTER (ndwi <> -32768 AND ndwi < 0) AS ndwi_negative, count(*) FILTER (ndwi <> -32768 AND abs(ndwi) > 10000) AS ndwi_outside_unit,
  count(*) FILTER (fm) AS flags_no_data, count(*) FILTER (nm) AS flags_not_multiple, count(*) FILTER (ok AND dec = 0) AS flags_none,
  count(*) FILTER (ok AND (dec & ~7) <> 0) AS flags_unknown_bits,
  {when_joined("count(*) FILTER (joined)")} AS joined_pixels, {when_joined("count(*) FILTER (usable)")} AS water_usable,
  {agree_sql("ndwi", "ndwi > 0")}, {agree_sql("acolite", "((dec >> 2) & 1) = 0")},
  {when_joined("count(*) FILTER (joined AND ok AND scl IN (8, 9, 10))")} AS scl_cloud,
  {when_joined("count(*) FILTER (joined AND ok AND scl IN (8, 9, 10) AND dec = 0)")} AS scl_cloud_unflagged,
  {when_joined("count(*) FILTER (joined AND ok AND scl = 3)")} AS scl_shadow,
  {when_joined("count(*) FILTER (joined AND ok AND scl = 3 AND dec = 0)")} AS scl_shadow_unflagged
FROM u GROUP BY ALL"""


def validity(spark, sf):
    return px.validity_counts(
        validity_pixels(spark, sf), ["scene", "pixel_class"], ndwi="ndwi", flags="flags", scl="scl", has_join="has_join", swir_bit=2, known_bits=7
    )


query("validity_by_scene_and_class", "F21 F22 X13 B56", VALIDITY)(lambda spark, sf: validity(spark, sf))


def band_sql(name: str) -> str:
    return f"""SELECT scene, pixel_class, '{name}' AS band, {when_joined("count(*) FILTER (joined)")} AS joined_pixels,
  count(*) FILTER ({name} = -32768) AS no_data, {when_joined(f"count(*) FILTER (joined AND {name} = -32768)")} AS processor_masked,
  count(*) FILTER ({name} <> -32768 AND {name} < 0) AS negative, count(*) FILTER ({name} > 10000) AS above_one FROM u GROUP BY ALL"""


BAND_COUNTS = VAL + ", bands AS (" + band_sql("B03") + " UNION ALL " + band_sql("B08") + ")"


def bands(spark, sf):
    return px.band_counts(validity_pixels(spark, sf), ["scene", "pixel_class"], ["B03", "B08"], scl="scl", has_join="has_join")


query("band_validity_counts", "F21 T10", BAND_COUNTS + " SELECT * FROM bands")(lambda spark, sf: bands(spark, sf))


@query("flag_bit_counts", "F21 B28", VAL + """ SELECT scene, f.flag, count(*) FILTER (ok AND ((dec >> f.bit) & 1) = 1) AS n
FROM u, (VALUES ('cloud', 0), ('glint', 1), ('swir', 2)) f(flag, bit) GROUP BY ALL""")
def _(spark, sf):
    return px.flag_bit_counts(validity_pixels(spark, sf), ["scene"], "flags", {"cloud": 0, "glint": 1, "swir": 2})


@query("class_histogram", "F21 B53", VAL + " SELECT pixel_class, scl, count(*) AS n FROM u WHERE has_join GROUP BY ALL")
def _(spark, sf):
    return validity_pixels(spark, sf).where("has_join").groupBy("pixel_class", "scl").agg(F.count(F.lit(1)).alias("n"))


@query("ndwi_recompute", "B31 F21", VAL + """, o AS (SELECT *, CAST(B03 AS DOUBLE) AS g, CAST(B08 AS DOUBLE) AS n FROM u WHERE B03 <> -32768 AND B08 <> -32768 AND ndwi <> -32768),
c AS (SELECT *, ((g - 5e-1) - (n - 5e-1)) / ((g - 5e-1) + (n - 5e-1)) AS c1, ((g - 5e-1) - (n + 5e-1)) / ((g - 5e-1) + (n + 5e-1)) AS c2,
  ((g + 5e-1) - (n - 5e-1)) / ((g + 5e-1) + (n - 5e-1)) AS c3, ((g + 5e-1) - (n + 5e-1)) / ((g + 5e-1) + (n + 5e-1)) AS c4 FROM o WHERE g + n - 1 > 0)
SELECT pixel_class, count(*) AS comparable, count(*) FILTER (ndwi >= least(c1, c2, c3, c4) * 10000 - 5e-1 AND ndwi <= greatest(c1, c2, c3, c4) * 10000 + 5e-1) AS agree FROM c GROUP BY ALL""")
def _(spark, sf):
    v = validity_pixels(spark, sf)
    ok = v.where((F.col("B03") != sc.NODATA) & (F.col("B08") != sc.NODATA) & (F.col("ndwi") != sc.NODATA))
    comparable, agrees = sc.ndwi_agrees(F.col("B03"), F.col("B08"), F.col("ndwi"))
    return ok.where(comparable).groupBy("pixel_class").agg(F.count(F.lit(1)).alias("comparable"), F.count_if(agrees).alias("agree"))


@query("validity_pooled", "F23 F38 F40 X12 U01", BAND_COUNTS + """ SELECT CASE WHEN grouping(scene) = 1 THEN 'all' ELSE 'scene' END AS kind,
  coalesce(scene, 'all') AS "group", pixel_class, band, CAST(sum(no_data) AS BIGINT) AS no_data, CAST(sum(processor_masked) AS BIGINT) AS processor_masked,
  round_even(sum(processor_masked) / CAST(nullif(sum(joined_pixels), 0) AS DOUBLE), 6) AS masked_share
FROM bands GROUP BY GROUPING SETS ((pixel_class, band), (scene, pixel_class, band))""")
def _(spark, sf):
    share = sc.share(F.sum("processor_masked"), F.sum("joined_pixels"))
    return pooled(
        bands(spark, sf), [[], ["scene"]], ["pixel_class", "band"],
        [F.sum("no_data").alias("no_data"), F.sum("processor_masked").alias("processor_masked"), share.alias("masked_share")],
    )


@query("class_verdicts", "F24", BAND_COUNTS + """, p AS (SELECT pixel_class, band, sum(processor_masked) AS m, sum(joined_pixels) AS j FROM bands GROUP BY ALL)
SELECT pixel_class, CAST(max(j) AS BIGINT) AS joined_pixels, max(round_even(m / CAST(nullif(j, 0) AS DOUBLE), 6)) AS largest_share,
  max(round_even(m / CAST(nullif(j, 0) AS DOUBLE), 6)) > 1e-2 AS masked_by_processor FROM p GROUP BY ALL""")
def _(spark, sf):
    return px.class_verdicts(bands(spark, sf), "pixel_class")


@query("no_data_diagnostic", "F39", VAL + """, a AS (SELECT scene, pixel_class, count(*) FILTER (B03 = -32768) AS band_no_data,
  count(*) FILTER (ok AND (dec & 1) = 1) AS out_of_scene FROM u GROUP BY ALL)
SELECT * FROM a WHERE band_no_data IS DISTINCT FROM out_of_scene""")
def _(spark, sf):
    v = validity_pixels(spark, sf)
    f = sc.decode_flags(F.col("flags"))
    out_bit = ~F.col("flags_missing") & ~F.col("not_multiple") & (F.col("decoded").bitwiseAND(F.lit(1)) == 1)
    counted = v.withColumns(f).groupBy("scene", "pixel_class").agg(
        F.count_if(F.col("B03") == sc.NODATA).alias("band_no_data"), F.count_if(out_bit).alias("out_of_scene")
    )
    return counted.where(~F.col("band_no_data").eqNullSafe(F.col("out_of_scene")))


# ------------------------------------------------------------------ paired values


def pairs(spark, sf):
    """Two integer values per lineitem: its own price, and a disturbed price. Parts bring the
    size class, so the pairs go through a join as the two products do."""
    li = load(spark, sf, "lineitem").select(
        "l_partkey", F.col("l_returnflag").alias("tile"), F.col("l_linestatus").alias("cls"), F.col("l_linenumber").alias("band"), "l_suppkey",
        F.floor(F.col("l_extendedprice") / 10).alias("a"), (F.col("l_quantity").cast("bigint") * 7 + F.col("l_orderkey") * 13).alias("w"),
    )
    p = load(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.floor(F.col("p_retailprice")).alias("retail"), F.col("p_size").alias("size"))
    noise = (F.col("w") + F.col("retail") * 3) % (F.col("band") * 8 + 60) - 40
    return li.join(p, "l_partkey").select(
        "tile", "cls", "band", F.col("l_suppkey").alias("record"), F.when(F.col("size") > 25, "large").otherwise("small").alias("size"),
        "a", (F.col("a") - noise).alias("s"), (F.col("retail") % 4 != 0).alias("clear"),
    )


PAIRS = """WITH raw AS (SELECT l_returnflag AS tile, l_linestatus AS cls, l_linenumber AS band, l_suppkey AS record,
  CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS size, CAST(floor(l_extendedprice / 10) AS BIGINT) AS a,
  (CAST(l_quantity AS BIGINT) * 7 + l_orderkey * 13 + CAST(floor(p_retailprice) AS BIGINT) * 3) % (l_linenumber * 8 + 60) - 40 AS noise,
  CAST(floor(p_retailprice) AS BIGINT) % 4 <> 0 AS clear FROM lineitem JOIN part ON l_partkey = p_partkey),
pairs AS (SELECT *, a - noise AS s, noise AS d FROM raw)"""
SUMMARY = """count(*) AS n, round_even(avg(d), 2) AS mean_difference, round_even(sqrt(avg(d * d)), 2) AS rms, round_even(avg(abs(d)), 2) AS mean_absolute,
  round_even(avg(a), 2) AS mean_first, round_even(avg(s), 2) AS mean_second, round_even(corr(a, s), 4) AS pearson_r,
  count(*) FILTER (abs(d) > 50) AS disagree, round_even(count(*) FILTER (abs(d) > 50) / CAST(count(*) AS DOUBLE), 4) AS share_disagree,
  round_even(count(*) FILTER (a < 0) / CAST(count(*) AS DOUBLE), 4) AS share_negative_first, round_even(count(*) FILTER (s < 0) / CAST(count(*) AS DOUBLE), 4) AS share_negative_second,
  count(*) FILTER (abs(d) > 5000) AS clipped, CASE WHEN 1 - count(*) FILTER (abs(d) > 50) / CAST(count(*) AS DOUBLE) >= 9e-1 THEN 'agree' ELSE 'differs' END AS verdict"""
STRATA = PAIRS + """, q AS (SELECT *, 'all' AS quality FROM pairs UNION ALL SELECT *, 'both_clear_water' FROM pairs WHERE clear),
strata AS (SELECT 'all' AS kind, 'all' AS "group", * FROM q UNION ALL SELECT 'tile', tile, * FROM q UNION ALL SELECT 'size', size, * FROM q)"""


def stratified(spark, sf):
    """Moments per quality subset, band and class at the finest stratum, pooled upward."""
    quality = F.explode(F.when(F.col("clear"), F.array(F.lit("all"), F.lit("both_clear_water"))).otherwise(F.array(F.lit("all"))))
    p = pairs(spark, sf).withColumn("quality", quality)
    fine = p.groupBy("tile", "size", "band", "cls", "quality").agg(*px.paired_sums("a", "s"))
    return pooled(fine, [[], ["tile"], ["size"]], ["band", "cls", "quality"], px.pooled_sums())


def pair_summary(spark, sf):
    return px.describe_pairs(stratified(spark, sf))


query("paired_value_summary", "F25 F27 F30 F33 U04 U05", STRATA + f""" SELECT kind, "group", band, cls, quality, {SUMMARY} FROM strata GROUP BY ALL""")(
    lambda spark, sf: pair_summary(spark, sf)
)


@query("difference_quantiles", "F26 F25 F27", STRATA + """ SELECT kind, "group", band, cls, quantile_disc(d, 0.05) AS p05, quantile_disc(d, 0.25) AS p25,
  quantile_disc(d, 0.5) AS p50, quantile_disc(d, 0.75) AS p75, quantile_disc(d, 0.95) AS p95 FROM strata WHERE quality = 'all' GROUP BY ALL""")
def _(spark, sf):
    fine = px.histogram(pairs(spark, sf), ["tile", "size", "band", "cls"], F.col("a") - F.col("s"), -px.DIFF_LIMIT, px.DIFF_LIMIT)
    hist = pooled(fine, [[], ["tile"], ["size"]], ["band", "cls", "bin"], [F.sum("n").alias("n")])
    return px.histogram_quantiles(hist, ["kind", "group", "band", "cls"], px.QUANTILES)


RECORDS = PAIRS + """, records AS (SELECT record, cls, count(*) AS n, round_even(median(d), 2) AS median, round_even(avg(d), 2) AS mean,
  round_even(count(*) FILTER (abs(d) > 50) / CAST(count(*) AS DOUBLE), 4) AS share_disagree FROM pairs GROUP BY ALL)"""


def records(spark, sf):
    p = pairs(spark, sf).withColumn("d", F.col("a") - F.col("s"))
    counts = p.groupBy("record", "cls").agg(
        sc.rounded(F.avg("d"), 2).alias("mean"), sc.rounded(F.count_if(F.abs("d") > 50) / F.count(F.lit(1)), 4).alias("share_disagree")
    )
    medians = linear(p, ["record", "cls"], "d", {"median": 0.5}, bucket=16)
    return medians.join(counts, ["record", "cls"]).select("record", "cls", "n", sc.rounded(F.col("median"), 2).alias("median"), "mean", "share_disagree")


query("record_summaries", "F28 B61", RECORDS + " SELECT * FROM records")(lambda spark, sf: records(spark, sf))


@query("spread_of_record_medians", "F29 F31", RECORDS + """ SELECT cls, count(*) AS records, round_even(min(median), 2) AS min, round_even(quantile_cont(median, 0.25), 2) AS p25,
  round_even(quantile_cont(median, 0.5), 2) AS median, round_even(quantile_cont(median, 0.75), 2) AS p75, round_even(max(median), 2) AS max FROM records WHERE n >= 100 GROUP BY cls""")
def _(spark, sf):
    r = records(spark, sf).where(F.col("n") >= sc.MIN_RECORD_PIXELS).select("cls", "median")
    s = linear(r, ["cls"], "median", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, bucket=4)
    return s.select(
        "cls", F.col("n").alias("records"), *[sc.rounded(F.col(c), 2).alias(n) for c, n in (("min", "min"), ("p25", "p25"), ("p50", "median"), ("p75", "p75"), ("max", "max"))]
    )


@query("band_verdicts", "F32", STRATA + f""", v AS (SELECT band, cls, quality, {SUMMARY} FROM strata WHERE kind = 'all' GROUP BY ALL)
SELECT cls, quality, verdict, string_agg(CAST(band AS VARCHAR), ',' ORDER BY band) AS bands, count(*) AS n FROM v GROUP BY ALL""")
def _(spark, sf):
    v = pair_summary(spark, sf).where("kind = 'all'")
    return v.groupBy("cls", "quality", "verdict").agg(
        F.array_join(F.array_sort(F.collect_set("band")).cast("array<string>"), ",").alias("bands"), F.count(F.lit(1)).alias("n")
    )


@query("offset_diagnostic", "D18 F31", PAIRS + """ SELECT tile, band, count(*) AS n, round(quantile_cont(a, 0.01), 2) AS p01, round(quantile_cont(a, 0.5), 2) AS p50 FROM pairs WHERE cls = 'O' GROUP BY ALL""")
def _(spark, sf):
    s = linear(pairs(spark, sf).where("cls = 'O'"), ["tile", "band"], "a", {"p01": 0.01, "p50": 0.5}, bucket=64)
    return s.select("tile", "band", "n", F.round("p01", 2).alias("p01"), F.round("p50", 2).alias("p50"))


# ------------------------------------------------------------------ tile overlap

WIDE = PAIRS + """, o AS (SELECT 'acolite' AS option, band, cls, size, abs(d) > 50 AS dis FROM pairs
  UNION ALL SELECT 'sen2cor', band, cls, size, abs(d + 12) > 50 FROM pairs),
c AS (SELECT option, band, cls, size, count(*) AS n, count(*) FILTER (dis) AS disagree FROM o GROUP BY ALL)"""


def option_counts(spark, sf):
    """Disagreement of both options per band, class and pair, from one pass."""
    d = F.col("a") - F.col("s")
    options = F.array(
        F.struct(F.lit("acolite").alias("option"), (F.abs(d) > 50).alias("dis")),
        F.struct(F.lit("sen2cor").alias("option"), (F.abs(d + 12) > 50).alias("dis")),
    )
    p = pairs(spark, sf).select("band", "cls", "size", F.inline(options))
    return p.groupBy("option", "band", "cls", "size").agg(F.count(F.lit(1)).alias("n"), F.count_if("dis").alias("disagree"))


@query("overlap_verdicts", "F34 F35 B34", WIDE + """ SELECT *, CASE WHEN n < 100 THEN 'too_few' WHEN 1 - disagree / CAST(n AS DOUBLE) >= 9e-1 THEN 'agree' ELSE 'differs' END AS verdict FROM c""")
def _(spark, sf):
    return option_counts(spark, sf).withColumn("verdict", sc.overlap_verdict(F.col("n"), F.col("disagree")))


@query("widening_by_band", "F36 B35", WIDE + """, s AS (SELECT band, cls, round(sum(disagree) FILTER (option = 'acolite') / CAST(sum(n) FILTER (option = 'acolite') AS DOUBLE), 4) AS acolite,
  round(sum(disagree) FILTER (option = 'sen2cor') / CAST(sum(n) FILTER (option = 'sen2cor') AS DOUBLE), 4) AS sen2cor FROM c GROUP BY ALL)
SELECT *, CASE WHEN acolite - sen2cor > 5e-2 THEN 'widens' WHEN sen2cor - acolite > 5e-2 THEN 'narrows' ELSE 'similar' END AS widening FROM s""")
def _(spark, sf):
    c = option_counts(spark, sf)

    def share(option):
        mine = F.col("option") == option
        return F.round(F.sum(F.when(mine, F.col("disagree"))) / F.sum(F.when(mine, F.col("n"))), 4).alias(option)

    wide = c.groupBy("band", "cls").agg(share("acolite"), share("sen2cor"))
    return wide.withColumn("widening", sc.widening(F.col("acolite"), F.col("sen2cor")))


@query("overlap_diagnostics", "F37 B33", WIDE + """, v AS (SELECT *, CASE WHEN n < 100 THEN 'too_few' WHEN 1 - disagree / CAST(n AS DOUBLE) >= 9e-1 THEN 'agree' ELSE 'differs' END AS verdict FROM c)
SELECT option, size, count(*) FILTER (verdict = 'differs') AS failing, count(*) AS strata, min(disagree) AS low, max(disagree) AS high FROM v GROUP BY ALL""")
def _(spark, sf):
    v = option_counts(spark, sf).withColumn("verdict", sc.overlap_verdict(F.col("n"), F.col("disagree")))
    return v.groupBy("option", "size").agg(
        F.count_if(F.col("verdict") == "differs").alias("failing"), F.count(F.lit(1)).alias("strata"), F.min("disagree").alias("low"), F.max("disagree").alias("high")
    )


@query("tile_pairs_sharing_members", "D07", """WITH m AS (SELECT DISTINCT l_linenumber AS region, l_partkey AS member, s_nationkey AS tile FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
SELECT a.region, a.tile AS tile_a, b.tile AS tile_b, a.tile % 3 = b.tile % 3 AS same_zone, count(*) AS shared
FROM m a JOIN m b ON a.region = b.region AND a.member = b.member AND a.tile < b.tile GROUP BY ALL""")
def _(spark, sf):
    li = load(spark, sf, "lineitem").select("l_suppkey", F.col("l_linenumber").alias("region"), F.col("l_partkey").alias("member"))
    s = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("tile"))
    m = li.join(s, "l_suppkey").withColumn("epsg", F.col("tile") % 3)
    return px.zone_pairs(m, "region", "tile", "epsg", "member")


@query("overlap_window_clip", "D14 D15 D16", """WITH w AS (SELECT o_orderkey AS k, o_custkey * 31 % 5400 AS r, o_orderkey * 17 % 5400 AS c, o_orderkey % 300 AS h, o_custkey % 300 AS w,
  (o_orderkey * 13 % 9001 - 4500) * 20 + CASE WHEN o_orderkey % 10 = 0 THEN 7 ELSE 0 END AS dy, (o_custkey * 11 % 9001 - 4500) * 20 AS dx FROM orders),
o AS (SELECT *, CASE WHEN dy % 20 = 0 THEN dy // 20 END AS dr, CASE WHEN dx % 20 = 0 THEN dx // 20 END AS dc FROM w),
x AS (SELECT *, greatest(r, -dr, 0) AS r0, greatest(c, -dc, 0) AS c0, least(r + h, 5490 - dr, 5490) AS r1, least(c + w, 5490 - dc, 5490) AS c1 FROM o WHERE dr IS NOT NULL AND dc IS NOT NULL)
SELECT k, r0 AS a_row, c0 AS a_col, r1 - r0 AS height, c1 - c0 AS width, r0 + dr AS b_row, c0 + dc AS b_col FROM x WHERE r1 > r0 AND c1 > c0""")
def _(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    w = load(spark, sf, "orders").select(
        k.alias("k"), (c * 31 % 5400).alias("row_off"), (k * 17 % 5400).alias("col_off"), (k % 300).alias("height"), (c % 300).alias("width"),
        ((k * 13 % 9001 - 4500) * 20 + F.when(k % 10 == 0, 7).otherwise(0)).alias("dy"), ((c * 11 % 9001 - 4500) * 20).alias("dx"),
    )
    zero = F.lit(0)
    rows, cols = px.origin_offset((zero, zero), (-F.col("dx"), F.col("dy")), 20)
    w = w.withColumns({"dr": px.whole_offset(rows), "dc": px.whole_offset(cols)}).where("dr is not null and dc is not null")
    window = {n: F.col(n) for n in ("row_off", "col_off", "height", "width")}
    clip = px.window_in_both(window, (F.col("dr"), F.col("dc")), 5490)
    return w.select("k", *[v.alias(n) for n, v in clip.items()]).where("height is not null")


TILES = """e AS (SELECT vec_id, unnest(embedding) AS f, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
px AS (SELECT vec_id % 2 AS tile, (vec_id // 2 // 16) * 8 + pos // 8 AS r, (vec_id // 2 % 16) * 8 + pos % 8 AS c,
  CASE WHEN (vec_id + pos) % 11 = 0 THEN 0 ELSE CAST(floor(CAST(f AS DOUBLE) * 10000 + 5e-1) AS BIGINT) END AS v FROM e)"""


def tile_pixels(spark, sf):
    b = blocks(spark, sf).where("band = 'red'").withColumn("vec_id", F.col("br") * 32 + F.col("bc"))
    p = b.select("vec_id", F.posexplode("values").alias("pos", "value"))
    half = F.floor(F.col("vec_id") / 2)
    return p.select(
        (F.col("vec_id") % 2).alias("tile"), (F.floor(half / 16) * 8 + F.floor(F.col("pos") / 8)).alias("row"),
        (half % 16 * 8 + F.col("pos") % 8).alias("col"), F.col("value").cast("bigint").alias("value"),
    )


@query("same_ground_in_two_tiles", "D17", f"""WITH {TILES} SELECT a.r AS "row", a.c - 2 AS col, a.v AS a_value, b.v AS b_value
FROM px a JOIN px b ON a.tile = 0 AND b.tile = 1 AND b.r = a.r AND b.c = a.c - 2 WHERE a.v <> 0 AND b.v <> 0""")
def _(spark, sf):
    p = tile_pixels(spark, sf)
    both = px.join_overlap(p.where("tile = 0"), p.where("tile = 1"), [], F.lit(0), F.lit(-2), ["value"])
    return both.where("a_value <> 0 and b_value <> 0")


@query("overlap_pair_summary", "D17 F35 F36", f"""WITH {TILES}, p AS (SELECT a.v AS a, b.v AS s, a.v - b.v AS d, a.r // 32 AS band
FROM px a JOIN px b ON a.tile = 0 AND b.tile = 1 AND b.r = a.r AND b.c = a.c - 2 WHERE a.v <> 0 AND b.v <> 0)
SELECT band, {SUMMARY} FROM p GROUP BY band""")
def _(spark, sf):
    p = tile_pixels(spark, sf)
    both = px.join_overlap(p.where("tile = 0"), p.where("tile = 1"), [], F.lit(0), F.lit(-2), ["value"])
    both = both.where("a_value <> 0 and b_value <> 0").withColumn("band", F.floor(F.col("row") / 32))
    return px.describe_pairs(both.groupBy("band").agg(*px.paired_sums("a_value", "b_value")))


MEANS = """WITH e AS (SELECT vec_id, unnest(embedding) AS f, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
px AS (SELECT (vec_id // 32) * 8 + pos // 8 AS r, (vec_id % 32) * 8 + pos % 8 AS c,
  CASE WHEN (vec_id + pos) % 11 = 0 THEN 0 ELSE CAST(floor(CAST(f AS DOUBLE) * 10000 + 5e-1) AS BIGINT) END AS v FROM e),
m AS (SELECT r // 2 AS "row", c // 2 AS col, sum(v) / 4e0 AS mean, count(*) FILTER (v <> 0) = 4 AS valid FROM px GROUP BY ALL)"""


def means(spark, sf):
    m = px.block_means(blocks(spark, sf).where("band = 'red'"), ["br", "bc"], 8, 8)
    return m.select((F.col("br") * 4 + F.col("r")).alias("row"), (F.col("bc") * 4 + F.col("c")).alias("col"), "mean", "valid")


query("block_means_20m", "D19", MEANS + " SELECT * FROM m")(lambda spark, sf: means(spark, sf))


def parents(spark, sf):
    return load(spark, sf, "part").select(
        F.floor(F.col("p_partkey") / 43).alias("row"), (F.col("p_partkey") % 43).alias("col"),
        F.when(F.col("p_partkey") % 9 == 0, F.lit(0)).otherwise(F.col("p_size") * 100).cast("bigint").alias("value"),
    )


PARENTS = MEANS + """, par AS (SELECT p_partkey // 43 AS prow, p_partkey % 43 AS pcol, CASE WHEN p_partkey % 9 = 0 THEN 0 ELSE CAST(p_size AS BIGINT) * 100 END AS parent FROM part),
j AS (SELECT m."row", m.col, mean, valid, parent, coalesce(parent <> 0, FALSE) AS parent_valid FROM m LEFT JOIN par ON m."row" // 3 = prow AND m.col // 3 = pcol)"""


@query("parent_values_60m", "D20", PARENTS + " SELECT * FROM j")
def _(spark, sf):
    return px.parent_values(means(spark, sf), parents(spark, sf), []).select("row", "col", "mean", "valid", "parent", "parent_valid")


@query("resampled_pair_differences", "D18 D22 D23", PARENTS + """ SELECT "row", col, round((mean * 1e-4 - 1e-1) * 10000 - (parent * 1e-4 - 1e-1) * 10000, 4) AS difference,
  abs(round((mean * 1e-4 - 1e-1) * 10000 - (parent * 1e-4 - 1e-1) * 10000, 4)) > 50 AS disagree FROM j WHERE valid AND parent_valid""")
def _(spark, sf):
    j = px.parent_values(means(spark, sf), parents(spark, sf), []).where("valid and parent_valid")
    scale, offset = F.lit(1e-4), F.lit(-0.1)
    d = F.round(px.to_units(F.col("mean"), scale, offset) - px.to_units(F.col("parent"), scale, offset), 4)
    return j.select("row", "col", d.alias("difference"), (F.abs(d) > 50).alias("disagree"))


@query("window_60m", "D21", """SELECT o_orderkey AS k, o_custkey // 3 AS row_off, o_orderkey // 3 AS col_off,
  (o_custkey + o_orderkey % 50) // 3 + 1 - o_custkey // 3 AS height, (o_orderkey + o_custkey % 40) // 3 + 1 - o_orderkey // 3 AS width FROM orders""")
def _(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    w = px.window_60m(c, k, k % 50 + 1, c % 40 + 1)
    return load(spark, sf, "orders").select(k.alias("k"), *[v.alias(n) for n, v in w.items()])


COPIES = f"""WITH {TILES}, two AS (SELECT tile, v AS first, CASE WHEN (r * 31 + c) % 97 = 0 THEN v ELSE CASE WHEN v = 0 THEN 0 ELSE greatest(v - 1000, 1) END END AS second FROM px)"""


def copies(spark, sf):
    v = F.col("value")
    moved = F.when(v == 0, 0).otherwise(F.greatest(v - 1000, F.lit(1)))
    second = F.when((F.col("row") * 31 + F.col("col")) % 97 == 0, v).otherwise(moved)
    return tile_pixels(spark, sf).select("tile", v.alias("first"), second.alias("second"))


@query("copy_comparison", "F42 F43 F87", COPIES + """ SELECT tile, count(*) AS pixels, count(*) FILTER (first = second) AS equal, count(*) FILTER (first <> second) AS differ,
  count(*) FILTER (first <> 0 AND second <> 0) AS both_valid, min(second - first) FILTER (first <> 0 AND second <> 0) AS low, max(second - first) FILTER (first <> 0 AND second <> 0) AS high,
  count(*) FILTER (first <> 0 AND second <> 0 AND second <> greatest(first - 1000, 1)) AS violations FROM two GROUP BY tile""")
def _(spark, sf):
    a, b = F.col("first"), F.col("second")
    both = (a != 0) & (b != 0)
    return copies(spark, sf).groupBy("tile").agg(
        F.count(F.lit(1)).alias("pixels"), F.count_if(a == b).alias("equal"), F.count_if(a != b).alias("differ"), F.count_if(both).alias("both_valid"),
        F.min(F.when(both, b - a)).alias("low"), F.max(F.when(both, b - a)).alias("high"),
        F.count_if(both & (b != F.greatest(a - 1000, F.lit(1)))).alias("violations"),
    )


@query("most_common_differences", "F42 F87", COPIES + """, n AS (SELECT tile, second - first AS diff, count(*) AS n FROM two WHERE first <> 0 AND second <> 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY n DESC, diff) AS rank FROM n) SELECT * FROM r WHERE rank <= 8""")
def _(spark, sf):
    c = copies(spark, sf).where("first <> 0 and second <> 0").withColumn("diff", F.col("second") - F.col("first"))
    return px.top_counts(c, ["tile"], "diff", 8).withColumn("rank", F.col("rank").cast("bigint"))
