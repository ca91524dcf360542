"""Coverage queries over orders as catalog items."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnscope.operators import coverage as cov
from tarnscope.operators.quantiles import nearest_rank
from tarnscope.plans.derived import ACQUISITIONS, acquisitions
from tarnscope.plans.registry import load, query

FLAGS = ("in_reference", "in_primary", "in_fallback")


def window(spark, sf):
    """First and last sensing date of the catalog as uncorrelated scalar subqueries."""
    o = load(spark, sf, "orders")
    return (
        o.select(F.to_date(F.min("o_orderdate"))).scalar(),
        o.select(F.to_date(F.max("o_orderdate"))).scalar(),
    )


def gaps(spark, sf):
    start, end = window(spark, sf)
    return cov.compare_archives(acquisitions(spark, sf), ["tile"], "month", "key", FLAGS, start, end)


GAPS = f"""WITH {ACQUISITIONS}, per_key AS (
  SELECT tile, month, key, count(*) AS items, bool_or(in_primary) AS p, bool_or(in_fallback) AS f
  FROM acquisitions GROUP BY ALL),
counts AS (
  SELECT tile, month, count(*) AS reference, count(*) FILTER (p) AS "primary",
    count(*) FILTER (NOT p) AS missing, count(*) FILTER (NOT p AND f) AS covered,
    count(*) FILTER (NOT p AND NOT f) AS uncovered
  FROM per_key GROUP BY ALL),
gaps AS (
  SELECT tile, month, coalesce(reference, 0) AS reference, coalesce("primary", 0) AS "primary",
    coalesce(missing, 0) AS missing, coalesce(covered, 0) AS covered_by_fallback,
    coalesce(uncovered, 0) AS uncovered, CAST(0 AS BIGINT) AS primary_not_in_reference,
    CASE WHEN coalesce(reference, 0) = 0 THEN 'no_reference' WHEN missing = 0 THEN 'complete'
      WHEN "primary" = 0 THEN 'empty' ELSE 'partial' END AS status
  FROM spine LEFT JOIN counts USING (tile, month))"""


@query("gap_status_by_tile_month", "D11 A24 D39 F03 F04", GAPS + " SELECT * FROM gaps")
def _(spark, sf):
    return gaps(spark, sf)


@query("gap_uncovered_keys", "D11", GAPS + " SELECT tile, month, key FROM per_key WHERE NOT p AND NOT f")
def _(spark, sf):
    return cov.uncovered_acquisitions(acquisitions(spark, sf), ["tile"], "month", "key", FLAGS)


@query("monthly_items_and_duplicates", "F12 F04", GAPS + """, m AS (
  SELECT tile, month, sum(items) AS items, count(*) AS acquisitions, count(*) FILTER (items > 1) AS d
  FROM per_key GROUP BY ALL)
SELECT tile, month, CAST(coalesce(items, 0) AS BIGINT) AS items, coalesce(acquisitions, 0) AS acquisitions,
  coalesce(d, 0) AS duplicate_acquisitions FROM spine LEFT JOIN m USING (tile, month)""")
def _(spark, sf):
    start, end = window(spark, sf)
    return cov.monthly_summary(acquisitions(spark, sf), ["tile"], "month", "key", start, end)


@query("baseline_counts", "B53 B65 F12 F64", f"""WITH {ACQUISITIONS}
SELECT tile, month, CASE WHEN baseline = '5' THEN 'None' ELSE baseline END AS baseline, count(*) AS n
FROM acquisitions GROUP BY ALL""")
def _(spark, sf):
    value = F.when(F.col("baseline") != "5", F.col("baseline"))
    return cov.value_counts(acquisitions(spark, sf), ["tile", "month"], value, "baseline")


@query("offset_flag_by_baseline", "F12 F13", f"""WITH {ACQUISITIONS}
SELECT baseline, count(*) FILTER (offset_applied) AS applied, count(*) FILTER (NOT offset_applied) AS not_applied
FROM acquisitions GROUP BY ALL""")
def _(spark, sf):
    a = acquisitions(spark, sf)
    return a.groupBy("baseline").agg(
        F.count_if("offset_applied").alias("applied"), F.count_if(~F.col("offset_applied")).alias("not_applied")
    )


@query("duplicate_baseline_sets", "F12 D38", f"""WITH {ACQUISITIONS}, c AS (
  SELECT tile, key, baseline, count(*) AS n FROM acquisitions GROUP BY ALL), s AS (
  SELECT tile, key, string_agg(baseline || 'x' || CAST(n AS VARCHAR), '+' ORDER BY baseline) AS "values"
  FROM c GROUP BY ALL HAVING sum(n) > 1)
SELECT "values", count(*) AS acquisitions FROM s GROUP BY ALL""")
def _(spark, sf):
    return cov.duplicate_sets(acquisitions(spark, sf), ["tile", "key"], "baseline")


@query("status_by_month", "F13 F66 F67", GAPS + """
SELECT month, count(*) FILTER (status = 'no_reference') AS tiles_no_reference,
  count(*) FILTER (status = 'primary_only') AS tiles_primary_only,
  count(*) FILTER (status = 'complete') AS tiles_complete, count(*) FILTER (status = 'empty') AS tiles_empty,
  count(*) FILTER (status = 'partial') AS tiles_partial, CAST(sum(missing) AS BIGINT) AS missing,
  CAST(sum(uncovered) AS BIGINT) AS uncovered, bool_and(status = 'empty') AS empty_everywhere,
  bool_or(status IN ('empty', 'partial')) AS incomplete_anywhere
FROM gaps GROUP BY ALL""")
def _(spark, sf):
    return cov.status_by_month(gaps(spark, sf))


@query("baselines_by_year", "F13", f"""WITH {ACQUISITIONS}
SELECT substr(month, 1, 4) AS year, in_primary AS "primary", baseline, count(*) AS n FROM acquisitions GROUP BY ALL""")
def _(spark, sf):
    a = acquisitions(spark, sf)
    return a.groupBy(F.substring("month", 1, 4).alias("year"), F.col("in_primary").alias("primary"), "baseline").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("incomplete_month_spans", "W03 D26 B23", GAPS + """, idx AS (
  SELECT tile, month, CAST(substr(month, 1, 4) AS INT) * 12 + CAST(substr(month, 6, 2) AS INT)
    - row_number() OVER (PARTITION BY tile ORDER BY month) AS island
  FROM gaps WHERE status IN ('empty', 'partial')),
s AS (SELECT tile, island, min(month) AS first, max(month) AS last, count(*) AS months FROM idx GROUP BY ALL)
SELECT tile, first, last, months, first || '-01' AS first_day,
  strftime(last_day(CAST(last || '-01' AS DATE)), '%Y-%m-%d') AS last_day FROM s""")
def _(spark, sf):
    spans = cov.month_spans(cov.incomplete_months(gaps(spark, sf)), ["tile"], "month")
    return spans.withColumns(
        {
            "first_day": F.concat("first", F.lit("-01")),
            "last_day": F.date_format(F.last_day(F.concat("last", F.lit("-01")).cast("date")), "yyyy-MM-dd"),
        }
    )


FALLBACK = f"""WITH {ACQUISITIONS}, graded AS (
  SELECT *, item % 12 AS assets, CASE WHEN NOT in_primary AND item % 5 <> 0 THEN TRUE ELSE FALSE END AS older,
    item % 12 >= 9 AS complete, CASE WHEN item % 7 = 0 THEN 0 ELSE item % 4 END AS jp2
  FROM acquisitions), ranked AS (
  SELECT *, CASE WHEN older THEN CASE WHEN complete THEN 4 WHEN assets > 5 THEN 3 WHEN jp2 > 0 THEN 2 ELSE 1 END END AS rnk
  FROM graded), best AS (
  SELECT *, row_number() OVER (PARTITION BY tile, month, key
    ORDER BY older DESC, complete DESC, assets DESC, baseline DESC, item DESC) AS rn FROM ranked), per_key AS (
  SELECT tile, month, key, coalesce(max(rnk), 0) AS r, bool_or(in_primary) AS p,
    max(CASE WHEN rn = 1 AND older THEN item END) AS best_item, max(CASE WHEN rn = 1 AND older THEN baseline END) AS best_baseline
  FROM best GROUP BY ALL), missing AS (
  SELECT tile, month, key, ['none','no_data_assets','jp2_only','partial_cog','complete_cog'][r + 1] AS coverage_class,
    best_item, best_baseline FROM per_key WHERE NOT p)"""


def fallback(spark, sf):
    a = acquisitions(spark, sf)
    item = F.col("item")
    return cov.fallback_per_acquisition(
        a.withColumns({"assets": item % 12, "jp2": F.when(item % 7 == 0, 0).otherwise(item % 4)}),
        ["tile", "month", "key"],
        reference=F.col("in_reference"),
        primary=F.col("in_primary"),
        older=~F.col("in_primary") & (item % 5 != 0),
        complete=F.col("assets") >= 9,
        cog_assets=F.greatest(F.col("assets") - 5, F.lit(0)),
        jp2_assets=F.col("jp2"),
        baseline=F.col("baseline"),
        item=item,
    )


@query("fallback_best_item", "C05 W02 F15", FALLBACK.replace("assets DESC", "greatest(assets - 5, 0) DESC") + " SELECT * FROM missing")
def _(spark, sf):
    return fallback(spark, sf)


@query("fallback_by_tile_month", "F15 D25", FALLBACK + """
SELECT tile, month, count(*) AS missing, count(*) FILTER (coverage_class = 'none') AS uncovered,
  count(*) FILTER (coverage_class = 'no_data_assets') AS no_data_assets,
  count(*) FILTER (coverage_class = 'jp2_only') AS jp2_only, count(*) FILTER (coverage_class = 'partial_cog') AS partial_cog,
  count(*) FILTER (coverage_class = 'complete_cog') AS complete_cog FROM missing GROUP BY ALL""")
def _(spark, sf):
    return cov.fallback_by_month(fallback(spark, sf), ["tile", "month"])


@query("fallback_totals", "F14 F64", FALLBACK.replace("assets DESC", "greatest(assets - 5, 0) DESC") + """
SELECT coalesce(best_baseline, 'None') AS baseline, count(*) AS n, min(best_item) AS low, max(best_item) AS high
FROM missing GROUP BY ALL""")
def _(spark, sf):
    m = fallback(spark, sf)
    return m.groupBy(F.coalesce("best_baseline", F.lit("None")).alias("baseline")).agg(
        F.count(F.lit(1)).alias("n"), F.min("best_item").alias("low"), F.max("best_item").alias("high")
    )


LOWEST = f"""WITH {ACQUISITIONS}, lowest AS (
  SELECT tile, key, min(cover) AS cover, bool_or(in_primary) AS present FROM acquisitions GROUP BY ALL)"""


def lowest(spark, sf):
    return cov.lowest_per_acquisition(acquisitions(spark, sf), ["tile", "key"], "cover", F.col("in_primary"))


@query("cloud_cover_bins_by_year", "F08 F07 B27", LOWEST + """, b AS (
  SELECT tile, substr(key, 1, 4) AS year, CASE WHEN present THEN 'present' ELSE 'missing' END AS side,
    CASE WHEN cover < 20 THEN '0-20' WHEN cover < 40 THEN '20-40' WHEN cover < 60 THEN '40-60'
      WHEN cover < 80 THEN '60-80' ELSE '80-100' END AS bin FROM lowest),
s AS (SELECT DISTINCT tile, year, side, unnest(['0-20','20-40','40-60','60-80','80-100']) AS bin FROM b)
SELECT s.tile, s.year, s.side, s.bin, count(b.tile) AS n FROM s LEFT JOIN b USING (tile, year, side, bin) GROUP BY ALL""")
def _(spark, sf):
    acq = lowest(spark, sf).withColumn("year", F.substring("key", 1, 4))
    return cov.cloud_comparison(acq, ["tile", "year"], "cover")


@query("nodata_share_by_presence", "F09 F07", LOWEST + """
SELECT substr(key, 1, 4) AS year, present, count(*) AS n, count(*) FILTER (cover > 50) AS over_50,
  quantile_disc(cover, 0.5) AS median, min(cover) AS low, max(cover) AS high FROM lowest GROUP BY ALL""")
def _(spark, sf):
    acq = lowest(spark, sf).withColumn("year", F.substring("key", 1, 4))
    counts = acq.groupBy("year", "present").agg(F.count_if(F.col("cover") > 50).alias("over_50"))
    ranks = nearest_rank(acq, ["year", "present"], "cover", {"median": 0.5}, bucket=16)
    return counts.join(ranks, ["year", "present"]).select(
        "year", "present", "n", "over_50", "median", F.col("min").alias("low"), F.col("max").alias("high")
    )


@query("coverage_pooled", "F10 F11 F20 F76", GAPS + """
SELECT CASE WHEN grouping(tile) = 1 THEN 'all' ELSE 'tile' END AS kind, coalesce(tile, 'all') AS "group",
  CAST(sum(reference) AS BIGINT) AS reference, CAST(sum("primary") AS BIGINT) AS "primary",
  CAST(sum(missing) AS BIGINT) AS missing, CAST(sum(uncovered) AS BIGINT) AS uncovered,
  round(sum(missing) / CAST(nullif(sum(reference), 0) AS DOUBLE), 6) AS missing_share
FROM gaps GROUP BY GROUPING SETS ((), (tile))""")
def _(spark, sf):
    g = gaps(spark, sf)
    sums = [F.sum(c).alias(c) for c in ("reference", "primary", "missing", "uncovered")]
    share = F.round(F.try_divide(F.sum("missing"), F.nullif(F.sum("reference"), F.lit(0))), 6)
    return cov.pooled(g, [[], ["tile"]], [], [*sums, share.alias("missing_share")])


@query("listing_matches_counts", "A23 A25 D39", f"""WITH {ACQUISITIONS}, l AS (
  SELECT tile, month, count(DISTINCT item) AS listed FROM acquisitions GROUP BY ALL), c AS (
  SELECT 'T' || lpad(CAST(o_custkey % 25 AS VARCHAR), 2, '0') AS tile, strftime(o_orderdate, '%Y-%m') AS month,
    count(*) AS counted FROM orders WHERE o_orderkey % 50 <> 0 GROUP BY ALL)
SELECT tile, month, coalesce(listed, 0) AS listed, coalesce(counted, 0) AS counted,
  coalesce(listed, 0) = coalesce(counted, 0) AS agree FROM l FULL JOIN c USING (tile, month)""")
def _(spark, sf):
    a = acquisitions(spark, sf)
    listed = a.select("tile", "month", "item").distinct().groupBy("tile", "month").agg(F.count(F.lit(1)).alias("n"))
    counted = a.where(F.col("item") % 50 != 0).groupBy("tile", "month").agg(F.count(F.lit(1)).alias("n"))
    return cov.listing_agreement(listed, counted, ["tile", "month"])


@query("survey_input_differences", "D27", f"""WITH {ACQUISITIONS}, a AS (
  SELECT DISTINCT tile, month FROM acquisitions WHERE in_primary), b AS (
  SELECT DISTINCT tile, month FROM acquisitions WHERE in_fallback)
SELECT tile, month, 'first' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT tile, month, 'second' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def _(spark, sf):
    a = acquisitions(spark, sf)
    return cov.input_differences(a.where("in_primary"), a.where("in_fallback"), ["tile", "month"])


@query("tiles_inside_scope", "F77", f"""WITH {ACQUISITIONS}
SELECT tile, bool_or(in_fallback) AS inside, count(*) AS items FROM acquisitions GROUP BY ALL""")
def _(spark, sf):
    a = acquisitions(spark, sf)
    return a.groupBy("tile").agg(F.bool_or("in_fallback").alias("inside"), F.count(F.lit(1)).alias("items"))
