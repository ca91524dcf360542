"""Cost scenarios over parts, suppliers and orders."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tarnscope.operators import costs as co
from tarnscope.plans.registry import load, query

RATES = (0.023, 0.022, 0.021)
PRICE = "least({g}, 51200e0) * 23e-3 + least(greatest({g} - 51200, 0e0), 460800e0) * 22e-3 + greatest({g} - 512000, 0e0) * 21e-3"


@query("storage_prices", "K01 K05", f"""SELECT p_partkey, round({PRICE.format(g="p_partkey * 4e2")}, 4) AS price,
  round(1.2e0 + least(greatest((p_size - 5) / 30e0, 0e0), 1e0) * 2.3e0, 6) AS ratio FROM part""")
def _(spark, sf):
    gib = F.col("p_partkey") * 400.0
    return load(spark, sf, "part").select(
        "p_partkey", F.round(co.storage_price(gib, RATES), 4).alias("price"), F.round(co.interpolate(F.col("p_size").cast("double"), (5.0, 1.2), (35.0, 3.5)), 6).alias("ratio")
    )


OCC = "({n} * {f} * (1 - exp(-({d} * {m} / ({n} * {f})))) + {n} * (1 - {f}) * (1 - exp(-({d} * (1 - {m}) / ({n} * (1 - {f}))))))"


@query("block_occupancy", "K02", f"""SELECT p_partkey, round({OCC.format(n="(p_size * 100e0)", f="2e-1", d="(p_partkey % 5000 + 1)", m="7e-1")}, 4) AS distinct_blocks FROM part""")
def _(spark, sf):
    d = (F.col("p_partkey") % 5000 + 1).cast("double")
    return load(spark, sf, "part").select(
        "p_partkey", F.round(co.occupancy(d, F.col("p_size") * 100.0, F.lit(0.2), F.lit(0.7)), 4).alias("distinct_blocks")
    )


@query("fitted_concentration", "K04 K07", """WITH RECURSIVE b AS (SELECT p_partkey, (p_partkey % 900 + 200) * 1e0 AS d, 1000e0 AS n FROM part),
s AS (SELECT *, n * 2e-1 * (1 - exp(-(d * 6e-1 / (n * 2e-1)))) + n * 8e-1 * (1 - exp(-(d * 4e-1 / (n * 8e-1)))) AS target FROM b),
r(p_partkey, d, n, target, lo, hi, i) AS (SELECT *, 2e-1, 1e0, 0 FROM s UNION ALL
  SELECT p_partkey, d, n, target, CASE WHEN o > target THEN mid ELSE lo END, CASE WHEN o > target THEN hi ELSE mid END, i + 1 FROM (
    SELECT *, (lo + hi) / 2 AS mid, n * 2e-1 * (1 - exp(-(d * ((lo + hi) / 2) / (n * 2e-1)))) + n * 8e-1 * (1 - exp(-(d * (1 - (lo + hi) / 2) / (n * 8e-1)))) AS o FROM r) WHERE i < 60)
SELECT p_partkey, round((lo + hi) / 2, 6) AS mass FROM r WHERE i = 60""")
def _(spark, sf):
    d, n, f = (F.col("p_partkey") % 900 + 200).cast("double"), F.lit(1000.0), F.lit(0.2)
    target = co.occupancy(d, n, f, F.lit(0.6))
    p = load(spark, sf, "part").select("p_partkey", d.alias("d"), target.alias("target"))
    return p.select("p_partkey", F.round(co.fit_mass(F.col("d"), n, f, F.col("target")), 6).alias("mass"))


@query("closed_area_bins", "K03", """WITH b AS (SELECT l_suppkey AS scenario, l_linenumber AS pos, count(*) AS c, l_linenumber * 5e-1 AS m FROM lineitem GROUP BY l_suppkey, l_linenumber),
s AS (SELECT scenario, sum(c) FILTER (pos <> 1) AS rest, max(pos) AS last FROM b GROUP BY scenario),
c AS (SELECT b.scenario, pos, CASE WHEN pos = 1 THEN 2000000 - rest ELSE c END AS n, m, last FROM b JOIN s USING (scenario)),
k AS (SELECT scenario, sum(n * m) FILTER (pos <> last) AS known FROM c GROUP BY scenario)
SELECT scenario, pos, CAST(n AS BIGINT) AS n, round(CASE WHEN pos = last THEN (5000000 - known) / n ELSE m END, 6) AS mean FROM c JOIN k USING (scenario)""")
def _(spark, sf):
    b = load(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("scenario"), F.col("l_linenumber").alias("pos")).agg(F.count(F.lit(1)).alias("n"))
    b = b.withColumns({"mean": F.col("pos") * 0.5, "total": F.lit(2_000_000), "area": F.lit(5_000_000.0)})
    out = co.close_population(b, ["scenario"], "pos", "n", "mean", "total", "area")
    return out.select("scenario", "pos", "n", F.round("mean", 6).alias("mean"))


@query("archive_objects", "K11", """SELECT p_partkey, CAST(ceil(greatest(3 * ceil(p_size / 3e0) * (p_partkey % 50), p_partkey * 1e9 / 256e6)) AS BIGINT) AS tile_month,
  CAST(3 * ceil(p_size / 3e0) * greatest(1, ceil(p_partkey * 1e9 / (3 * ceil(p_size / 3e0)) / 256e6)) AS BIGINT) AS grid_month FROM part""")
def _(spark, sf):
    history, months, tiles = F.col("p_partkey") * 1e9, F.col("p_size") / 3.0, F.col("p_partkey") % 50
    return load(spark, sf, "part").select(
        "p_partkey", co.object_count(history, months, tiles, 3, 256e6, "tile_month").cast("bigint").alias("tile_month"),
        co.object_count(history, months, tiles, 3, 256e6, "grid_month").cast("bigint").alias("grid_month"),
    )


@query("acquisition_rates", "K08 K09 K10 K22 F78 F79", """WITH m AS (SELECT o_custkey % 25 AS tile, strftime(o_orderdate, '%Y-%m') AS month, count(DISTINCT o_orderdate) AS n FROM orders GROUP BY ALL),
y AS (SELECT tile, CAST(sum(n) AS BIGINT) AS epochs, CAST(sum(n) FILTER (month >= (SELECT strftime(max(o_orderdate) - INTERVAL 12 MONTH, '%Y-%m') FROM orders)) AS BIGINT) AS recent, max(n) AS peak, round(max(n) / avg(n), 6) AS peak_ratio FROM m GROUP BY tile)
SELECT *, round((epochs + 30 * recent / 365.25e0) / (SELECT datediff('day', min(o_orderdate), max(o_orderdate)) + 1 FROM orders) * 365.25e0, 6) AS annual_rate FROM y""")
def _(spark, sf):
    m = load(spark, sf, "orders").select((F.col("o_custkey") % 25).alias("tile"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderdate").distinct()
    m = m.groupBy("tile", "month").agg(F.count(F.lit(1)).alias("n"))
    bounds = load(spark, sf, "orders").select(F.struct(F.min("o_orderdate").alias("low"), F.max("o_orderdate").alias("high"))).scalar()
    m = m.withColumn("period", bounds)
    recent = F.col("month") >= F.date_format(F.add_months("period.high", -12), "yyyy-MM")
    days = F.date_diff(F.max("period.high"), F.max("period.low")) + 1
    y = m.groupBy("tile").agg(
        F.sum("n").alias("epochs"), F.sum(F.when(recent, F.col("n"))).alias("recent"), F.max("n").alias("peak"), days.alias("days"),
        F.round(F.max("n") / F.avg("n"), 6).alias("peak_ratio"),
    )
    rate = co.acquisition_rate(F.col("epochs"), F.lit(30), F.col("recent"), F.col("days"))
    return y.withColumn("annual_rate", F.round(rate, 6)).drop("days")


def scenarios(spark, sf):
    """A scenario per part and case: low, base and high inputs are expanded in the row."""
    cases = F.array(*[F.struct(F.lit(n).alias("case"), F.lit(m).alias("multiplier"), F.lit(c).alias("compression")) for n, m, c in (("low", 1.0, 3.0), ("base", 1.2, 2.0), ("high", 1.5, 1.2))])
    p = load(spark, sf, "part").select("p_partkey", "p_size", F.inline(cases))
    k, s = F.col("p_partkey"), F.col("p_size").cast("double")
    return p.select(
        "p_partkey", "case", "multiplier", "compression", (k % 1000 + 10).cast("double").alias("bodies"), (s * 10).alias("water_km2"), (s * 3).alias("perimeter_km"),
        F.when(k % 2 == 0, 0.1).otherwise(0.0).alias("radius_km"), F.lit(20.0).alias("resolution_m"), F.lit(22.0).alias("value_bytes"), F.lit(4.0).alias("flag_bytes"),
        F.lit(1.1).alias("overlap"), F.lit(1.5).alias("membership"), F.lit(200.0).alias("metadata_bytes"), (k % 100 + 1).cast("double").alias("acquisitions"),
    )


EST = f"""WITH s AS (SELECT p_partkey, c.name AS "case", c.m AS multiplier, c.c AS compression, (p_partkey % 1000 + 10) * 1e0 AS bodies, p_size * 10e0 AS water, p_size * 3e0 AS per,
  CASE WHEN p_partkey % 2 = 0 THEN 1e-1 ELSE 0e0 END AS radius, (p_partkey % 100 + 1) * 1e0 AS acq FROM part, (VALUES ('low', 1e0, 3e0), ('base', 1.2e0, 2e0), ('high', 1.5e0, 1.2e0)) c(name, m, c)),
p AS (SELECT *, greatest(water / 4e-4 + 2 * per / (2e-2 * {math.pi!r}) + bodies, (water + radius * per + {math.pi!r} * radius * radius * bodies) / 4e-4) AS pixels FROM s),
e AS (SELECT *, (pixels * 26 * 1.1e0 + bodies * 1.5e0 * 200) * multiplier / compression AS epoch FROM p)"""


@query("retained_estimates", "K12 K23 K16 K17", EST + """ SELECT p_partkey, "case", round(pixels, 2) AS pixels, round(epoch / 1e6, 4) AS epoch_mb, round(epoch * acq / 1e9, 4) AS history_gb FROM e""")
def _(spark, sf):
    e = co.retained_estimate(scenarios(spark, sf))
    return e.select(
        "p_partkey", "case", F.round("pixels", 2).alias("pixels"), F.round(F.col("epoch_bytes") / 1e6, 4).alias("epoch_mb"), F.round(F.col("history_bytes") / 1e9, 4).alias("history_gb")
    )


@query("storage_forecast", "K13 K21", EST + f""", m AS (SELECT *, unnest(range(1, 13)) AS month FROM e),
f AS (SELECT *, (epoch * acq + month * epoch) / 1073741824e0 AS g1, (epoch * acq + (month - 5e-1) * epoch) / 1073741824e0 AS g2 FROM m)
SELECT p_partkey, "case", round(max({PRICE.format(g="g1")}) FILTER (month = 12), 4) AS end_month_price, round(sum({PRICE.format(g="g2")}), 4) AS cumulative_price, round(max(g1), 4) AS retained_gib FROM f GROUP BY ALL""")
def _(spark, sf):
    e = co.retained_estimate(scenarios(spark, sf))
    f = co.forecast_storage(e, "history_bytes", "epoch_bytes", F.lit(12), RATES)
    return f.select("p_partkey", "case", *[F.round(c, 4).alias(c) for c in ("end_month_price", "cumulative_price", "retained_gib")])


@query("storage_classes", "K14", f"""WITH v AS (SELECT p_partkey, p_partkey * 1e9 AS vol, p_size * 3 AS age, (p_partkey % 300) * 1e3 AS obj FROM part),
g AS (SELECT *, vol / 1073741824e0 AS g, CASE WHEN obj >= 131072 AND age >= 90 THEN 'cold' WHEN obj >= 131072 AND age >= 30 THEN 'warm' ELSE 'frequent' END AS cls FROM v),
t AS (SELECT *, {PRICE.format(g="g")} AS std FROM g)
SELECT p_partkey, cls AS storage_class, round(std, 4) AS standard_price, round(CASE cls WHEN 'cold' THEN g * 4e-3 WHEN 'warm' THEN g * 125e-4 ELSE std END, 4) AS tiered_price, cls <> 'frequent' AND g > 0 AS cheaper FROM t""")
def _(spark, sf):
    v = load(spark, sf, "part").select(
        "p_partkey", (F.col("p_partkey") * 1e9).alias("vol"), (F.col("p_size") * 3).alias("age"), (F.col("p_partkey") % 300 * 1e3).alias("obj")
    )
    out = co.tiered_cost(v, "vol", "age", "obj", minimum=131072, warm_days=30, cold_days=90, warm_rate=0.0125, cold_rate=0.004, rates=RATES)
    return out.select("p_partkey", "storage_class", F.round("standard_price", 4).alias("standard_price"), F.round("tiered_price", 4).alias("tiered_price"), "cheaper")


@query("estimate_sensitivities", "K15 K18", EST.replace("FROM part, (VALUES", "FROM part, (VALUES").split(",\np AS")[0] + f""", v AS (SELECT s.*, x.varied, f.factor FROM s, (VALUES ('water_km2'), ('bodies')) x(varied), (VALUES (5e-1), (2e0)) f(factor)),
w AS (SELECT p_partkey, "case", varied, factor, multiplier, compression, CASE WHEN varied = 'bodies' THEN bodies * factor ELSE bodies END AS bodies, CASE WHEN varied = 'water_km2' THEN water * factor ELSE water END AS water, per, radius, acq FROM v),
p AS (SELECT *, greatest(water / 4e-4 + 2 * per / (2e-2 * {math.pi!r}) + bodies, (water + radius * per + {math.pi!r} * radius * radius * bodies) / 4e-4) AS pixels FROM w)
SELECT "case", varied, factor, count(*) AS scenarios, round(sum((pixels * 26 * 1.1e0 + bodies * 1.5e0 * 200) * multiplier / compression * acq) / 1e12, 4) AS history_tb FROM p GROUP BY ALL""")
def _(spark, sf):
    out = co.sensitivities(scenarios(spark, sf), ["water_km2", "bodies"], [0.5, 2.0], co.retained_estimate)
    return out.groupBy("case", "varied", "factor").agg(F.count(F.lit(1)).alias("scenarios"), F.round(F.sum("history_bytes") / 1e12, 4).alias("history_tb"))


@query("overlaid_settings", "K16 K17 K20", """SELECT p_partkey, CAST(CASE WHEN p_size % 2 = 0 THEN p_size * 10 ELSE p_size END AS BIGINT) AS tiles, p_partkey % 7 AS grids, CAST(CASE WHEN p_size % 2 = 1 THEN 3 END AS BIGINT) AS extra, CASE WHEN p_size % 2 = 1 THEN 3 ELSE 2 END AS settings FROM part""")
def _(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size").cast("bigint")
    base = F.create_map(F.lit("tiles"), s, F.lit("grids"), k % 7)
    over = F.when(s % 2 == 0, F.create_map(F.lit("tiles"), s * 10)).otherwise(F.create_map(F.lit("extra"), F.lit(3).cast("bigint")))
    m = load(spark, sf, "part").select("p_partkey", co.overlay(base, over).alias("m"))
    return m.select("p_partkey", *[F.try_element_at("m", F.lit(n)).alias(n) for n in ("tiles", "grids", "extra")], F.size("m").alias("settings"))


@query("reader_calibration", "K06 F85", """WITH c AS (SELECT l_linenumber AS reader, l_returnflag AS cohort, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS cpu, CAST(sum(l_partkey) AS DOUBLE) AS requested, CAST(sum(l_suppkey) AS DOUBLE) AS decoded FROM lineitem GROUP BY ALL)
SELECT reader, round(avg(cpu / (requested / 1e6)), 6) AS cpu_per_mb, round(avg(requested / decoded), 6) AS requested_per_decoded, round(median(requested), 2) AS median_requested, count(*) AS cohorts FROM c GROUP BY reader""")
def _(spark, sf):
    c = load(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("reader"), F.col("l_returnflag").alias("cohort")).agg(
        F.sum(F.col("l_quantity").cast("bigint")).alias("cpu"), F.sum("l_partkey").alias("requested"), F.sum("l_suppkey").alias("decoded")
    )
    return c.groupBy("reader").agg(
        F.round(F.avg(F.col("cpu") / (F.col("requested") / 1e6)), 6).alias("cpu_per_mb"), F.round(F.avg(F.col("requested") / F.col("decoded")), 6).alias("requested_per_decoded"),
        F.round(F.median("requested"), 2).alias("median_requested"), F.count(F.lit(1)).alias("cohorts"),
    )
