"""Membership and support of concave bodies in tiles and slanted footprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnscope.operators import overlay as ov
from tarnscope.operators.geometry import assign_primary_tile, by_shuffle
from tarnscope.plans.geometry import LAKES, lakes, tiles
from tarnscope.plans.registry import load, query

REACH, SPACING, PASSES = 100.0, 20.0, 3


def ring_of(*points):
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in points])


def bays(spark, sf):
    """An L-shaped body per customer, every second one with an island wound like its outer ring."""
    c = F.col("c_custkey")
    rows = load(spark, sf, "customer").select(c.alias("body"), (c * 37 % 5200).alias("l"), (c * 91 % 5200).alias("b"), (60 + c % 100 * 3).alias("w"), (80 + c % 80 * 4).alias("h"))
    l, b, w, h = (F.col(k) for k in "lbwh")
    outer = ring_of((l, b), (l + w, b), (l + w, b + h / 2), (l + w / 2, b + h / 2), (l + w / 2, b + h), (l, b + h), (l, b))
    island = ring_of((l + w / 8, b + h / 8), (l + w * 3 / 8, b + h / 8), (l + w * 3 / 8, b + h * 3 / 8), (l + w / 8, b + h * 3 / 8), (l + w / 8, b + h / 8))
    both = [F.struct(F.lit(i).alias("ring"), pts.alias("pts")) for i, pts in enumerate((outer, island))]
    return rows.select("body", F.lit(0).alias("part"), F.inline(F.when(F.col("body") % 2 == 0, F.array(*both)).otherwise(F.array(both[0]))))


def items(spark, sf):
    """Every pass sees every tile; its data lie between two slanted lines."""
    passes = F.explode(F.sequence(F.lit(0), F.lit(PASSES - 1)))
    return tiles(spark, sf).select("tile", passes.alias("pass")).select((F.col("tile") * PASSES + F.col("pass")).alias("item"), "tile", "pass")


def footprints(spark, sf):
    low = F.col("pass") * 1800 - 500 + F.col("tile") % 3 * 40
    edge = lambda c, y: (c - F.lit(y) / 4, F.lit(y))
    pts = ring_of(edge(low, -2000), edge(low + 3000, -2000), edge(low + 3000, 8000), edge(low, 8000), edge(low, -2000))
    return items(spark, sf).select("item", F.lit(0).alias("part"), F.lit(0).alias("ring"), pts.alias("pts"))


BAYS = """WITH bays AS (SELECT c_custkey AS body, c_custkey * 37 % 5200 AS l, c_custkey * 91 % 5200 AS b, 60 + c_custkey % 100 * 3 AS w, 80 + c_custkey % 80 * 4 AS h FROM customer),
parts AS (SELECT body, 1 AS sign, l AS x0, l + w AS x1, b + 0e0 AS y0, b + h / 2e0 AS y1 FROM bays
  UNION ALL SELECT body, 1, l, l + w / 2e0, b + h / 2e0, b + h FROM bays
  UNION ALL SELECT body, -1, l + w / 8e0, l + w * 3 / 8e0, b + h / 8e0, b + h * 3 / 8e0 FROM bays WHERE body % 2 = 0),
areas AS (SELECT body, sum(sign * (x1 - x0) * (y1 - y0)) AS area FROM parts GROUP BY 1),
tiles AS (SELECT CAST(n_nationkey AS BIGINT) AS tile, CAST(n_nationkey AS BIGINT) % 5 * 1000 AS x, CAST(n_nationkey AS BIGINT) // 5 * 1000 AS y FROM nation),
items AS (SELECT tile * 3 + p AS item, tile, p AS pass, p * 1800 - 500 + tile % 3 * 40 AS low FROM tiles, (VALUES (0), (1), (2)) v(p)),
near AS (SELECT body, tile, x, y FROM bays, tiles WHERE l - 100 < x + 1098 AND l + w + 100 > x AND b - 100 < y + 1098 AND b + h + 100 > y),
lines AS (SELECT body, yc, greatest(b - yc, yc - b - h / 2e0, 0) AS d1, greatest(b - yc, yc - b - h, 0) AS d2, l, w, b, h FROM (SELECT *,
  (unnest(range(CAST(ceil((b - 100) / 20 - 5e-1) AS BIGINT), CAST(ceil((b + h + 100) / 20 - 5e-1) AS BIGINT))) + 5e-1) * 20 AS yc FROM bays)),
support AS (SELECT body, yc, l - sqrt(10000 - d2 * d2) AS x0, greatest(l + w / 2e0 + sqrt(10000 - d2 * d2), CASE WHEN d1 <= 100 AND yc < b + h / 2e0 + 100 THEN l + w + sqrt(10000 - d1 * d1) END) AS x1 FROM lines),
cut AS (SELECT body, tile, yc, greatest(x0, x) AS x0, least(x1, x + 1098) AS x1 FROM support JOIN near USING (body)
  WHERE yc >= y AND yc < y + 1098 AND x0 < x + 1098 AND x1 > x)"""

CORNER = "pow(greatest(0, {c} - {x} - {y} / 4), 2)"
BELOW = "2 * (" + " + ".join(s + CORNER.format(c="{c}", x=x, y=y) for s, x, y in (("", "x0", "y0"), ("-", "x1", "y0"), ("-", "x0", "y1"), ("", "x1", "y1"))) + ")"


@query("membership_in_footprints", "D12 D13 E08", BAYS + f""", it AS (SELECT body, tile, sum(sign * greatest(least(x1, x + 1098) - greatest(x0, x), 0) * greatest(least(y1, y + 1098) - greatest(y0, y), 0)) AS a,
  min(CASE WHEN sign = 1 THEN sqrt(pow(greatest(x - x1, x0 - x - 1098, 0), 2) + pow(greatest(y - y1, y0 - y - 1098, 0), 2)) END) AS gap FROM near JOIN parts USING (body) GROUP BY ALL),
fp AS (SELECT body, item, sum(sign * ({BELOW.format(c="(low + 3000)")} - {BELOW.format(c="low")})) AS a FROM (SELECT DISTINCT body, item, low FROM near JOIN items USING (tile)) JOIN parts USING (body) GROUP BY ALL),
sf AS (SELECT body, tile, item, sum(greatest(least(x1, low + 3000 - yc / 4) - greatest(x0, low - yc / 4), 0)) / sum(x1 - x0) AS s FROM cut JOIN items USING (tile) GROUP BY ALL)
SELECT body, tile, item, round(it.a / area + 1e-8, 5) AS in_tile, round(fp.a / area + 1e-8, 5) AS in_footprint, round(coalesce(s, 0) + 1e-8, 5) AS support_in_footprint, gap <= 100 AS member
FROM it JOIN areas USING (body) JOIN items USING (tile) JOIN fp USING (body, item) LEFT JOIN sf USING (body, tile, item)""")
def _(spark, sf):
    found = ov.membership(bays(spark, sf), tiles(spark, sf), items(spark, sf).select("item", "tile"), footprints(spark, sf), cell=1000.0, spacing=SPACING, reach=REACH)
    shares = [F.round(F.col(c) + 1e-8, 5).alias(c) for c in ("in_tile", "in_footprint", "support_in_footprint")]
    return found.select("body", "tile", "item", *shares, "member")


@query("support_by_acquisition", "E24", BAYS + """, sup AS (SELECT body, sum(x1 - x0) * 20 AS s FROM support GROUP BY 1),
products AS (SELECT body, pass, yc, greatest(x0, low - yc / 4) AS x0, least(x1, low + 3000 - yc / 4) AS x1 FROM cut JOIN items USING (tile)),
ends AS (SELECT body, pass, yc, x0 AS x, 1 AS step FROM products WHERE x0 < x1 UNION ALL SELECT body, pass, yc, x1, -1 FROM products WHERE x0 < x1
  UNION ALL SELECT body, -1, yc, x0, 1 FROM cut UNION ALL SELECT body, -1, yc, x1, -1 FROM cut),
walk AS (SELECT body, pass, sum(step) OVER (k ORDER BY x ROWS UNBOUNDED PRECEDING) AS depth, (lead(x) OVER (k ORDER BY x) - x) * 20 AS a
  FROM (SELECT body, pass, yc, x, sum(step) AS step FROM ends GROUP BY ALL) WINDOW k AS (PARTITION BY body, pass, yc)),
depth AS (SELECT body, pass, coalesce(sum(a) FILTER (depth >= 1), 0) AS once, coalesce(sum(a) FILTER (depth >= 2), 0) AS twice FROM walk GROUP BY ALL)
SELECT g.body, g.pass, round(s, 2) AS support_m2, round(greatest(s - coalesce(t.once, 0), 0) + 1e-6, 2) AS tiles_uncovered_m2, round(greatest(s - coalesce(p.once, 0), 0) + 1e-6, 2) AS uncovered_m2,
  round(coalesce(p.twice, 0) + 1e-6, 2) AS overlap_m2, round(greatest(s - coalesce(p.once, 0), 0) / s + 1e-8, 5) AS uncovered_share
FROM (SELECT DISTINCT body, pass FROM near JOIN items USING (tile)) g JOIN sup USING (body) LEFT JOIN depth t ON t.body = g.body AND t.pass = -1 LEFT JOIN depth p ON p.body = g.body AND p.pass = g.pass""")
def _(spark, sf):
    found = ov.support_by_group(bays(spark, sf), tiles(spark, sf), items(spark, sf), footprints(spark, sf), "pass", cell=1000.0, spacing=SPACING, reach=REACH)
    return found.select(
        "body", "pass", F.round("support_m2", 2).alias("support_m2"), *[F.round(F.col(c) + 1e-6, 2).alias(c) for c in ("tiles_uncovered_m2", "uncovered_m2", "overlap_m2")],
        F.round(F.col("uncovered_share") + 1e-8, 5).alias("uncovered_share"),
    )


# The area on lines of the support of a rectangle, in closed form per line.
REFINED = LAKES.split(",\ntiles AS")[0] + """, rounds AS (SELECT unnest(range(0, 9)) AS round),
walk AS (SELECT body, round, 40 / pow(2, round) AS s, l, b, w, h FROM lakes, rounds),
yc AS (SELECT *, (unnest(range(CAST(ceil((b - 100) / s - 5e-1) AS BIGINT), CAST(ceil((b + h + 100) / s - 5e-1) AS BIGINT))) + 5e-1) * s AS y FROM walk),
area AS (SELECT body, round, s, sum(w + 2 * sqrt(10000 - pow(greatest(b - y, y - b - h, 0), 2))) * s AS a FROM yc GROUP BY body, round, s),
step AS (SELECT *, abs(a - lag(a) OVER (PARTITION BY body ORDER BY round)) / a AS change FROM area),
done AS (SELECT *, coalesce(max(CASE WHEN change <= 2e-4 THEN 1 ELSE 0 END) OVER (PARTITION BY body ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over FROM step)
SELECT body, CAST(round AS INTEGER) AS round, s AS spacing, round(a, 2) AS area, round(change + 1e-9, 7) AS change, coalesce(change <= 2e-4, FALSE) AS converged FROM done WHERE over = 0"""


@query("support_refinement", "E23", REFINED)
def _(spark, sf):
    series = ov.refined_support(lakes(spark, sf), start=40.0, tolerance=2e-4, reach=REACH)
    return series.select("body", "round", "spacing", F.round("area", 2).alias("area"), F.round(F.col("change") + 1e-9, 7).alias("change"), "converged")


@query("primary_tiles_by_support", "T01 W07", LAKES.split(",\nshares")[0] + """, lines AS (SELECT *, (unnest(range(CAST(ceil((b - 100) / 10 - 5e-1) AS BIGINT), CAST(ceil((b + h + 100) / 10 - 5e-1) AS BIGINT))) + 5e-1) * 10 AS yc FROM lakes),
sup AS (SELECT body, yc, l - sqrt(10000 - pow(greatest(b - yc, yc - b - h, 0), 2)) AS x0, l + w + sqrt(10000 - pow(greatest(b - yc, yc - b - h, 0), 2)) AS x1 FROM lines),
z AS (SELECT body, tile, zone = body % 2 AS same, sum(least(x1, x + 1098) - greatest(x0, x)) / any_value(s) AS share
  FROM sup JOIN (SELECT body, sum(x1 - x0) AS s FROM sup GROUP BY 1) USING (body), tiles WHERE yc >= y AND yc < y + 1098 AND x0 < x + 1098 AND x1 > x GROUP BY body, tile, zone),
m AS (SELECT *, bool_or(same) OVER (PARTITION BY body) AS any_same FROM z),
c AS (SELECT *, max(round(share, 6)) OVER (PARTITION BY body) AS top FROM m WHERE same = any_same),
p AS (SELECT body, min(tile) FILTER (round(top - round(share, 6), 9) <= 1e-2) AS primary_tile FROM c GROUP BY body)
SELECT z.body, z.tile, round(round(share, 6) + 1e-8, 5) AS buffered_share, CASE WHEN z.tile = p.primary_tile THEN 'primary' ELSE 'overlap' END AS role FROM z JOIN p USING (body)""")
def _(spark, sf):
    shares = ov.buffered_shares(lakes(spark, sf), tiles(spark, sf), cell=1000.0, spacing=10.0, reach=REACH)
    shares = shares.withColumns({"same_zone": F.col("zone") == F.col("body") % 2, "share": F.round("share", 6)})
    roles = assign_primary_tile(shares, "body", "tile", "same_zone", "share")
    return roles.select("body", "tile", F.round(F.col("share") + 1e-8, 5).alias("buffered_share"), "role")


def plots(spark, sf):
    """A rectangle in degrees per customer; every seventh is drawn crosswise and so crosses itself."""
    c = F.col("c_custkey")
    rows = load(spark, sf, "customer").select(
        c.alias("body"), ((c * 977 % 30000) / 100.0 - 150).alias("l"), ((c * 613 % 10000) / 100.0 - 50).alias("b"), (0.01 + c % 9 * 0.004).alias("w"), (0.008 + c % 5 * 0.003).alias("h"),
        F.lit(0).alias("part"), F.lit(0).alias("ring"),
    )
    l, b, w, h = (F.col(k) for k in "lbwh")
    corners = [(l, b), (l + w, b), (l + w, b + h), (l, b + h)]
    plain, crossed = ring_of(*corners, corners[0]), ring_of(corners[0], corners[2], corners[1], corners[3], corners[0])
    from tarnscope.functions.scalars import utm_epsg

    return rows.select("body", "part", "ring", F.when(F.col("body") % 7 == 0, crossed).otherwise(plain).alias("pts"), utm_epsg(l + w / 2, b).cast("bigint").alias("epsg"))


PLOTS = """WITH plots AS (SELECT c_custkey AS body, (c_custkey * 977 % 30000) / 1e2 - 150 AS l, (c_custkey * 613 % 10000) / 1e2 - 50 AS b, 1e-2 + c_custkey % 9 * 4e-3 AS w, 8e-3 + c_custkey % 5 * 3e-3 AS h FROM customer)"""


@query("crossed_polygons", "E02 E04", PLOTS + """ SELECT body, CAST(CASE WHEN body % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) AS crossings,
  CAST(2 * (ceil(CASE WHEN body % 7 = 0 THEN sqrt(w * w + h * h) ELSE w END / 23e-4) + ceil(h / 23e-4)) AS BIGINT) AS pieces,
  CASE WHEN body % 7 = 0 THEN 0e0 ELSE round(w * h * pow(6371008.8 * pi() / 180, 2) * cos(radians(b + h / 2)), 1) END AS area_m2 FROM plots""")
def _(spark, sf):
    rings = ov.spread_pieces(plots(spark, sf), ["body"], 0.0023)
    whole = ov.projected_edges(rings, ["body"], "epsg", 1.0)
    crossed = ov.crossed_edges(whole, ["body"], 250.0)
    pieces = ov.projected_edges(rings, ["body"], "epsg", 0.0023).groupBy("body").agg(F.count_if(F.col("x1").isNotNull() & F.col("y2").isNotNull()).alias("pieces"))
    areas = ov.plane_areas(rings, ["body"]).join(by_shuffle(pieces), "body").join(by_shuffle(crossed), "body", "left")
    return areas.select("body", F.coalesce("crossings", F.lit(0)).alias("crossings"), "pieces", (F.round("area_m2", 1) + 0.0).alias("area_m2"))
