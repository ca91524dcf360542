"""Geometry and mask queries over polygons derived from suppliers and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnscope.operators import geometry as geo
from tarnscope.operators import masks as mk
from tarnscope.operators import store
from tarnscope.plans.registry import load, query
from tarnscope.session import scratch_path

X0, Y0, SIZE = 600_000.0, 3_800_000.0, 160


def box_points(west, south, east, north):
    """Closed ring of a rectangle."""
    corners = [(west, south), (east, south), (east, north), (west, north), (west, south)]
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in corners])


def rings(spark, sf):
    """A rectangle per supplier, every second one with a rectangular hole. Some reach over the
    tile edge. The hole is wound the same way as its outer ring, as sources do at times."""
    s = F.col("s_suppkey")
    b = load(spark, sf, "supplier").select(
        s.alias("body"), (X0 + s * 37 % 1500 + (s % 10) * 0.7).alias("l"), (Y0 - s * 53 % 1500 - (s % 7) * 0.4).alias("t"),
        (35 + s * 13 % 140 + 0.3).alias("w"), (42 + s * 29 % 160 + 0.6).alias("h"),
    )
    l, t, w, h = (F.col(c) for c in "ltwh")
    outer = F.struct(F.lit(0).alias("ring"), box_points(l, t - h, l + w, t).alias("pts"))
    hole = F.struct(F.lit(1).alias("ring"), box_points(l + w / 4, t - h * 3 / 4, l + w * 3 / 4, t - h / 4).alias("pts"))
    both = F.when(F.col("body") % 2 == 0, F.array(outer, hole)).otherwise(F.array(outer))
    return b.select("body", F.lit(0).alias("part"), F.inline(both))


def gridded(spark, sf, resolution=10, size=SIZE):
    cells = size * 10 // resolution
    return rings(spark, sf).withColumns(
        {"resolution": F.lit(float(resolution)), "x0": F.lit(X0), "y0": F.lit(Y0), "rows": F.lit(cells), "cols": F.lit(cells)}
    )


BODIES = """bodies AS (SELECT s_suppkey AS body, s_suppkey * 37 % 1500 + (s_suppkey % 10) * 7e-1 AS l, s_suppkey * 53 % 1500 + (s_suppkey % 7) * 4e-1 AS t,
  35 + s_suppkey * 13 % 140 + 3e-1 AS w, 42 + s_suppkey * 29 % 160 + 6e-1 AS h, s_suppkey % 2 = 0 AS hole FROM supplier)"""


def mask_sql(res: int) -> str:
    n = SIZE * 10 // res
    return f"""WITH {BODIES}, cells0 AS (SELECT *, unnest(range(greatest(0, CAST(floor((t - 110) / {res}) AS BIGINT)), least({n}, CAST(ceil((t + h + 110) / {res}) AS BIGINT)))) AS "row" FROM bodies),
cells AS (SELECT *, unnest(range(greatest(0, CAST(floor((l - 110) / {res}) AS BIGINT)), least({n}, CAST(ceil((l + w + 110) / {res}) AS BIGINT)))) AS col FROM cells0),
geo AS (SELECT *, col * {res} AS cx, "row" * {res} AS cy, (col + 5e-1) * {res} AS px, ("row" + 5e-1) * {res} AS py,
  l + w / 4 AS hl, l + w * 3 / 4 AS hr, t + h / 4 AS ht, t + h * 3 / 4 AS hb FROM cells),
cov AS (SELECT *, (greatest(least(cx + {res}, l + w) - greatest(cx, l), 0) * greatest(least(cy + {res}, t + h) - greatest(cy, t), 0)
   - CASE WHEN hole THEN greatest(least(cx + {res}, hr) - greatest(cx, hl), 0) * greatest(least(cy + {res}, hb) - greatest(cy, ht), 0) ELSE 0 END) / {res * res}e0 AS coverage,
  px >= l AND px < l + w AND py >= t AND py < t + h AND NOT (hole AND px >= hl AND px < hr AND py >= ht AND py < hb) AS center_in,
  CASE WHEN px >= l AND px <= l + w AND py >= t AND py <= t + h THEN least(px - l, l + w - px, py - t, t + h - py)
    ELSE sqrt(pow(greatest(l - px, 0, px - l - w), 2) + pow(greatest(t - py, 0, py - t - h), 2)) END AS d0,
  CASE WHEN NOT hole THEN 1e9 WHEN px >= hl AND px <= hr AND py >= ht AND py <= hb THEN least(px - hl, hr - px, py - ht, hb - py)
    ELSE sqrt(pow(greatest(hl - px, 0, px - hr), 2) + pow(greatest(ht - py, 0, py - hb), 2)) END AS d1 FROM geo),
mask AS (SELECT body, "row", col, coverage, center_in, least(d0, d1) AS d, CASE WHEN coverage >= 1 - 1e-6 THEN 1 WHEN coverage > 1e-6 THEN 2
  WHEN least(d0, d1) <= 100 + 1e-9 THEN 3 END AS pixel_class FROM cov)"""


MASK_ROWS = """ SELECT body, "row", col, CAST(pixel_class AS BIGINT) AS pixel_class, round(greatest(coverage, 0) + 1e-8, 6) AS coverage,
  round(CASE WHEN center_in AND pixel_class < 3 THEN -d ELSE d END + 1e-7, 4) + 0e0 AS edge_distance FROM mask WHERE pixel_class IS NOT NULL"""


def mask(spark, sf, resolution=10):
    return mk.mask_pixels(gridded(spark, sf, resolution), ["body"], resolution=float(resolution))


def mask_rows(spark, sf, resolution):
    m = mask(spark, sf, resolution)
    return m.select(
        "body", "row", "col", F.col("pixel_class").cast("bigint").alias("pixel_class"), F.round(F.greatest("coverage", F.lit(0.0)) + 1e-8, 6).alias("coverage"),
        (F.round(F.col("edge_distance") + 1e-7, 4) + 0.0).alias("edge_distance"),
    )


query("mask_pixels_10m", "E10 E11 E12 E33 U06 A10", mask_sql(10) + MASK_ROWS)(lambda spark, sf: mask_rows(spark, sf, 10))
query("mask_pixels_20m", "E12 E27 E28 E29", mask_sql(20) + MASK_ROWS)(lambda spark, sf: mask_rows(spark, sf, 20))


@query("prepared_masks", "X19 E33 A20", mask_sql(20) + """ SELECT b.body, b.body % 3 <> 0 AS reused, count(m.body) AS pixels
FROM bodies b LEFT JOIN mask m ON m.body = b.body AND pixel_class IS NOT NULL GROUP BY b.body""")
def _(spark, sf):
    """Every third body has moved since the first run: the second computes those alone."""
    path = scratch_path(spark, "prepared")
    now = gridded(spark, sf, 20)
    earlier = now.withColumn("pts", F.when(F.col("body") % 3 == 0, F.transform("pts", lambda p: F.struct((p.x + 10).alias("x"), p.y.alias("y")))).otherwise(F.col("pts")))
    store.prepare_masks(earlier, ["body"], path, resolution=20.0)
    pixels, told = store.prepare_masks(now, ["body"], path, resolution=20.0)
    counts = pixels.groupBy("body").agg(F.count(F.lit(1)).alias("pixels"))
    return told.join(counts, "body", "left").select("body", "reused", F.coalesce("pixels", F.lit(0)).alias("pixels"))


@query("exact_coverage_10m", "E10", mask_sql(10) + """ SELECT body, "row", col, round(coverage + 1e-8, 6) AS coverage FROM mask WHERE coverage > 1e-6""")
def _(spark, sf):
    edges = mk.pixel_edges(gridded(spark, sf), ["body"], ("resolution", "x0", "y0", "rows", "cols"))
    covered = mk.coverage(edges, ["body"]).where(F.col("coverage") > mk.TOLERANCE)
    return covered.select("body", "row", "col", F.round(F.col("coverage") + 1e-8, 6).alias("coverage"))


@query("center_pixels_10m", "E30", mask_sql(10) + """ SELECT body, "row", col FROM mask WHERE center_in""")
def _(spark, sf):
    return mk.center_pixels(gridded(spark, sf), ["body"])


@query("mask_counts_10m", "E12 E16 T11", mask_sql(10) + """ SELECT body, count(*) FILTER (pixel_class = 1) AS interior, count(*) FILTER (pixel_class = 2) AS shoreline,
  count(*) FILTER (pixel_class = 3) AS near_land, round(sum(coverage) * 100, 4) AS coverage_area_m2 FROM mask GROUP BY body""")
def _(spark, sf):
    counts = mk.mask_counts(mask(spark, sf), rings(spark, sf), ["body"], 10.0)
    return counts.withColumn("coverage_area_m2", F.round("coverage_area_m2", 4))


@query("wet_pixel_windows", "E15 E32 E14", mask_sql(10) + """ SELECT body, min("row") AS row_off, min(col) AS col_off, max("row") - min("row") + 1 AS height,
  max(col) - min(col) + 1 AS width, count(*) AS pixels FROM mask WHERE pixel_class < 3 GROUP BY body""")
def _(spark, sf):
    edges = mk.pixel_edges(gridded(spark, sf), ["body"], ("resolution", "x0", "y0", "rows", "cols"))
    wet = mk.coverage(edges, ["body"]).where(mk.classify(F.col("coverage")).isNotNull())
    return mk.tight_window(wet, ["body"])


@query("grown_wet_pixels", "E31", mask_sql(10) + """, w AS (SELECT body, "row", col FROM mask WHERE pixel_class < 3),
d(i) AS (VALUES (-1), (0), (1)) SELECT DISTINCT body, "row" + a.i AS "row", col + b.i AS col FROM w, d a, d b""")
def _(spark, sf):
    edges = mk.pixel_edges(gridded(spark, sf), ["body"], ("resolution", "x0", "y0", "rows", "cols"))
    wet = mk.coverage(edges, ["body"]).where(mk.classify(F.col("coverage")).isNotNull())
    return mk.grow(wet, ["body"])


def edge_cases(spark, sf):
    """Rectangles that end on grid lines, a hair beyond them, or between them; some lie outside the tile."""
    s = F.col("s_suppkey")
    b = load(spark, sf, "supplier").select(
        s.alias("body"), (X0 + s * 37 % 150 * 10 + F.when(s % 25 == 0, 5000).otherwise(0)).alias("l"), (Y0 - s * 53 % 150 * 10).alias("t"),
        (20 + s * 13 % 9 * 10 + F.element_at(F.array(F.lit(0.0), F.lit(2e-6), F.lit(3.7)), (s % 3 + 1).cast("int"))).alias("w"), (30 + s * 29 % 7 * 10 + F.when(s % 4 == 3, 4.2).otherwise(0.0)).alias("h"),
    )
    pts = box_points(F.col("l"), F.col("t") - F.col("h"), F.col("l") + F.col("w"), F.col("t"))
    return b.select("body", F.lit(0).alias("part"), F.lit(0).alias("ring"), pts.alias("pts"), F.lit(10.0).alias("resolution"), F.lit(X0).alias("x0"), F.lit(Y0).alias("y0"), F.lit(SIZE).alias("rows"), F.lit(SIZE).alias("cols"))


# A closed pixel meets the closed rectangle; what it covers is a hair or nothing where they meet in a line.
TOUCH = """WITH bodies AS (SELECT s_suppkey AS body, s_suppkey * 37 % 150 * 10 + CASE WHEN s_suppkey % 25 = 0 THEN 5000 ELSE 0 END AS l, s_suppkey * 53 % 150 * 10 AS t,
  20 + s_suppkey * 13 % 9 * 10 + [0e0, 2e-6, 37e-1][CAST(s_suppkey % 3 AS INT) + 1] AS w, 30 + s_suppkey * 29 % 7 * 10 + CASE WHEN s_suppkey % 4 = 3 THEN 42e-1 ELSE 0e0 END AS h FROM supplier),
r AS (SELECT *, unnest(range(greatest(0, t // 10 - 1), least(160, CAST(floor((t + h) / 10) AS BIGINT) + 1))) AS "row" FROM bodies),
p AS (SELECT *, unnest(range(greatest(0, l // 10 - 1), least(160, CAST(floor((l + w) / 10) AS BIGINT) + 1))) AS col FROM r),
cells AS (SELECT body, "row", col, greatest(0, least(l + w, col * 10 + 10) - greatest(l, col * 10)) * greatest(0, least(t + h, "row" * 10 + 10) - greatest(t, "row" * 10)) / 100 AS c FROM p)"""


@query("touched_pixels_10m", "E13 E30", TOUCH + """ SELECT body, "row", col FROM cells""")
def _(spark, sf):
    return mk.touched_pixels(edge_cases(spark, sf), ["body"])


@query("naive_mask_counts_10m", "E12 E13 E16", TOUCH + """ SELECT body, count(c) AS naive, count(c) FILTER (c <= 1e-6) AS naive_only, count(c) FILTER (c > 0 AND c <= 1e-6) AS naive_only_sliver,
  count(c) FILTER (c = 0) AS naive_only_empty, CAST(0 AS BIGINT) AS classes_only FROM bodies LEFT JOIN cells USING (body) GROUP BY body""")
def _(spark, sf):
    rings_in = edge_cases(spark, sf)
    return mk.naive_counts(mk.touch_cells(rings_in, ["body"]), rings_in, ["body"])


@query("polygon_measures", "E04 E05 E06 E07", f"""WITH {BODIES} SELECT body, round(w * h - CASE WHEN hole THEN w * h / 4 ELSE 0 END, 4) AS area,
  round(l, 4) AS west, round(0 - (t + h), 4) AS south, round(l + w, 4) AS east, round(0 - t, 4) AS north, CAST(CASE WHEN hole THEN 10 ELSE 5 END AS BIGINT) AS vertices FROM bodies""")
def _(spark, sf):
    m = geo.polygon_measures(rings(spark, sf), ["body"])
    return m.select(
        "body", F.round("area", 4).alias("area"), F.round(F.col("west") - X0, 4).alias("west"), F.round(F.col("south") - Y0, 4).alias("south"),
        F.round(F.col("east") - X0, 4).alias("east"), F.round(F.col("north") - Y0, 4).alias("north"), "vertices",
    )


@query("boundary_lengths", "E03 E02", f"""WITH {BODIES} SELECT body, CAST(CASE WHEN hole THEN 8 ELSE 4 END AS BIGINT) AS edges,
  round(2 * (w + h) * CASE WHEN hole THEN 1.5e0 ELSE 1 END, 4) AS boundary_m,
  CAST(2 * (ceil(round(w, 6) / 25) + ceil(round(h, 6) / 25) + CASE WHEN hole THEN ceil(round(w / 2, 6) / 25) + ceil(round(h / 2, 6) / 25) ELSE 0 END) AS BIGINT) AS pieces FROM bodies""")
def _(spark, sf):
    edges = geo.boundary_edges(rings(spark, sf), ["body"])
    length = F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2))
    whole = edges.groupBy("body").agg(F.count(F.lit(1)).alias("edges"), F.round(F.sum(length), 4).alias("boundary_m"))
    pieces = geo.densify(edges, 25.0).groupBy("body").agg(F.count(F.lit(1)).alias("pieces"))
    return whole.join(pieces, "body")


@query("body_windows", "E09 E14 E17 E20 B58", f"""WITH {BODIES}, x AS (SELECT body, greatest(CAST(floor(round(t - 100, 6) / 10) AS BIGINT), 0) AS r0, greatest(CAST(floor(round(l - 100, 6) / 10) AS BIGINT), 0) AS c0,
  least(CAST(ceil(round(t + h + 100, 6) / 10) AS BIGINT), 160) AS r1, least(CAST(ceil(round(l + w + 100, 6) / 10) AS BIGINT), 160) AS c1 FROM bodies)
SELECT body, r0 AS row_off, c0 AS col_off, greatest(r1 - r0, 0) AS height, greatest(c1 - c0, 0) AS width FROM x""")
def _(spark, sf):
    m = geo.polygon_measures(rings(spark, sf), ["body"])
    bounds = {c: F.round(F.col(c), 6) for c in ("west", "south", "east", "north")}
    w = geo.window_for(bounds, F.lit(X0), F.lit(Y0), F.lit(SIZE), F.lit(SIZE), F.lit(10), 100.0)
    return m.select("body", *[v.cast("bigint").alias(n) for n, v in w.items()])


UTM = """WITH p AS (SELECT c_custkey AS k, (c_custkey * 977 % 36000) / 1e2 - 180 AS lon, (c_custkey * 613 % 14000) / 1e2 - 70 AS lat FROM customer),
z AS (SELECT *, least(60, greatest(1, CAST(floor((lon + 180) / 6) AS BIGINT) + 1)) AS zone FROM p),
c AS (SELECT *, CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + zone AS epsg, (1 / 298257223563e-9) / (2 - 1 / 298257223563e-9) AS n, radians(lat) AS phi, radians(lon - (zone * 6 - 183)) AS lam FROM z),
t AS (SELECT *, 6378137 / (1 + n) * (1 + n * n / 4 + pow(n, 4) / 64) AS a, 2 * sqrt(n) / (1 + n) AS e,
  sinh(atanh(sin(phi)) - (2 * sqrt(n) / (1 + n)) * atanh((2 * sqrt(n) / (1 + n)) * sin(phi))) AS t FROM c),
x AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta, n/2 - 2*pow(n,2)/3 + 5*pow(n,3)/16 + 41*pow(n,4)/180 AS a1,
  13*pow(n,2)/48 - 3*pow(n,3)/5 + 557*pow(n,4)/1440 AS a2, 61*pow(n,3)/240 - 103*pow(n,4)/140 AS a3, 49561*pow(n,4)/161280 AS a4 FROM t)
SELECT k, epsg, round(500000 + 9.996e-1 * a * (eta + a1*cos(2*xi)*sinh(2*eta) + a2*cos(4*xi)*sinh(4*eta) + a3*cos(6*xi)*sinh(6*eta) + a4*cos(8*xi)*sinh(8*eta)), 2) AS x,
  round(CASE WHEN lat < 0 THEN 10000000 ELSE 0 END + 9.996e-1 * a * (xi + a1*sin(2*xi)*cosh(2*eta) + a2*sin(4*xi)*cosh(4*eta) + a3*sin(6*xi)*cosh(6*eta) + a4*sin(8*xi)*cosh(8*eta)), 2) AS y FROM x"""


@query("utm_vertices", "E01 B52 E25", UTM)
def _(spark, sf):
    from tarnscope.functions.scalars import utm_epsg

    k = F.col("c_custkey")
    p = load(spark, sf, "customer").select(
        k.alias("k"), ((k * 977 % 36000) / 100.0 - 180).alias("lon"), ((k * 613 % 14000) / 100.0 - 70).alias("lat")
    ).withColumn("epsg", utm_epsg(F.col("lon"), F.col("lat")).cast("bigint"))
    v = geo.project_vertices(p, "lon", "lat", "epsg")
    return v.select("k", "epsg", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"))


# ------------------------------------------------------------------ tiles

TILE_M, STEP_M = 1098, 1000


def tiles(spark, sf):
    n = F.col("n_nationkey").cast("bigint")
    west, south = n % 5 * STEP_M, F.floor(n / 5) * STEP_M
    return load(spark, sf, "nation").select(
        n.alias("tile"), west.cast("double").alias("west"), south.cast("double").alias("south"),
        (west + TILE_M).cast("double").alias("east"), (south + TILE_M).cast("double").alias("north"), (n % 2).alias("zone"),
    )


def lakes(spark, sf):
    c = F.col("c_custkey")
    b = load(spark, sf, "customer").select(
        c.alias("body"), (c * 37 % 5200).cast("double").alias("l"), (c * 91 % 5200).cast("double").alias("b"),
        (20 + c % 100).cast("double").alias("w"), (30 + c % 80).cast("double").alias("h"),
    )
    pts = box_points(F.col("l"), F.col("b"), F.col("l") + F.col("w"), F.col("b") + F.col("h"))
    return b.select("body", F.lit(0).alias("part"), F.lit(0).alias("ring"), pts.alias("pts"))


LAKES = """WITH lakes AS (SELECT c_custkey AS body, c_custkey * 37 % 5200 AS l, c_custkey * 91 % 5200 AS b, 20 + c_custkey % 100 AS w, 30 + c_custkey % 80 AS h FROM customer),
tiles AS (SELECT CAST(n_nationkey AS BIGINT) AS tile, CAST(n_nationkey AS BIGINT) % 5 * 1000 AS x, CAST(n_nationkey AS BIGINT) // 5 * 1000 AS y, CAST(n_nationkey AS BIGINT) % 2 AS zone FROM nation),
shares AS (SELECT body, tile, zone, round_even(greatest(least(l + w, x + 1098) - greatest(l, x), 0) * greatest(least(b + h, y + 1098) - greatest(b, y), 0) / CAST(w * h AS DOUBLE), 6) AS in_tile
  FROM lakes, tiles WHERE l - 100 < x + 1098 AND l + w + 100 > x AND b - 100 < y + 1098 AND b + h + 100 > y)"""


def shares(spark, sf):
    return geo.tile_shares(lakes(spark, sf), tiles(spark, sf), cell=1000.0, buffer=100.0)


query("lake_shares_in_tiles", "D12 D13 E08 E26", LAKES + " SELECT * FROM shares")(lambda spark, sf: shares(spark, sf))


@query("primary_tiles", "T01 W07", LAKES + """, z AS (SELECT *, zone = body % 2 AS same FROM shares),
m AS (SELECT *, bool_or(same) OVER (PARTITION BY body) AS any_same FROM z),
c AS (SELECT *, max(in_tile) OVER (PARTITION BY body) AS top FROM m WHERE same = any_same),
p AS (SELECT body, min(tile) FILTER (round(top - in_tile, 9) <= 1e-2) AS primary_tile FROM c GROUP BY body)
SELECT z.body, z.tile, z.in_tile, CASE WHEN z.tile = p.primary_tile THEN 'primary' ELSE 'overlap' END AS role FROM z JOIN p USING (body)""")
def _(spark, sf):
    s = shares(spark, sf).withColumn("same_zone", F.col("zone") == F.col("body") % 2)
    return geo.assign_primary_tile(s, "body", "tile", "same_zone", "in_tile")


@query("tiles_at_points", "D40 C02 A16", LAKES + """ SELECT tile, count(*) AS points FROM lakes, tiles
WHERE l >= x AND l < x + 1098 AND b >= y AND b < y + 1098 GROUP BY tile""")
def _(spark, sf):
    points = lakes(spark, sf).select("body", F.element_at("pts", 1).x.alias("x"), F.element_at("pts", 1).y.alias("y"))
    found = geo.point_in_tiles(points, tiles(spark, sf), cell=1000.0)
    return found.groupBy("tile").agg(F.count(F.lit(1)).alias("points"))


@query("union_boxes_by_zone", "E25 E26", LAKES.split(",\nshares")[0] + """ SELECT body % 7 AS region, min(l) - 100 AS west, min(b) - 100 AS south, max(l + w) + 100 AS east, max(b + h) + 100 AS north FROM lakes GROUP BY ALL""")
def _(spark, sf):
    m = geo.polygon_measures(lakes(spark, sf), ["body"])
    return m.groupBy((F.col("body") % 7).alias("region")).agg(
        (F.min("west") - 100).cast("bigint").alias("west"), (F.min("south") - 100).cast("bigint").alias("south"),
        (F.max("east") + 100).cast("bigint").alias("east"), (F.max("north") + 100).cast("bigint").alias("north"),
    )


# Pixels of a task.
PIXELS = 1_000_000
SUPPORT = LAKES + """, px AS (SELECT body, l, b, w, h, l + unnest(range(0, w, 10)) AS px FROM lakes), pp AS (SELECT body, px, b + unnest(range(0, h, 10)) AS py FROM px),
hit AS (SELECT body, px, py, count(tile) AS n FROM pp LEFT JOIN tiles ON px >= x AND px < x + 1098 AND py >= y AND py < y + 1098 GROUP BY ALL)"""


def support_pixels(spark, sf):
    """A pixel every 10 m of the box of every lake, the pixels of a lake in one task."""
    span = lambda v: F.array_max(F.col("pts")[v]) - F.array_min(F.col("pts")[v])
    dealt = geo.spread(lakes(spark, sf), ["body"], F.ceil(span("x") / 10) * F.ceil(span("y") / 10), PIXELS, whole=True)
    m = geo.polygon_measures(dealt, ["body"])
    xs = m.select("body", "south", "north", F.explode(F.sequence(F.col("west").cast("bigint"), F.col("east").cast("bigint") - 1, F.lit(10))).alias("x"))
    return xs.select("body", "x", F.explode(F.sequence(F.col("south").cast("bigint"), F.col("north").cast("bigint") - 1, F.lit(10))).alias("y"))


@query("support_coverage", "E24 E23", SUPPORT + """ SELECT body, count(*) AS support, count(*) FILTER (n = 0) AS uncovered, count(*) FILTER (n > 1) AS overlap,
  round_even(count(*) FILTER (n = 0) / CAST(count(*) AS DOUBLE), 6) AS uncovered_share FROM hit GROUP BY body""")
def _(spark, sf):
    from tarnscope.operators.contract import support_coverage

    return support_coverage(support_pixels(spark, sf), tiles(spark, sf), cell=1000.0)


# ------------------------------------------------------------------ header and grid checks


def headers(spark, sf):
    """A declared grid per lineitem beside the tile grid it should share."""
    k, p, n = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber")
    res = F.element_at(F.array(F.lit(10), F.lit(20), F.lit(60), F.lit(30)), (p % 4 + 1).cast("int"))
    cells = F.floor(F.lit(109_800) / res)
    x0 = F.lit(600_000.0) + F.when(k % 7 == 0, 5.0).otherwise(0.0)
    return load(spark, sf, "lineitem").select(
        k.alias("k"), p.alias("p"), F.col("l_suppkey").alias("s"), n.alias("n"), res.alias("res"),
        F.when(n != 7, F.array(res.cast("double"), F.lit(0.0), x0, F.lit(0.0), -res.cast("double"), F.lit(4_000_020.0))).alias("transform"),
        F.array(cells, F.when(k % 11 == 0, cells + 1).otherwise(cells)).alias("shape"), x0.alias("x0"), cells.alias("cells"),
    )


@query("asset_grid_mismatch", "C11 C06 C07 C08 C17 E17", """WITH h AS (SELECT l_orderkey AS k, l_partkey AS p, l_suppkey AS s, l_linenumber AS n FROM lineitem)
SELECT k, p, s, n, CASE WHEN n = 7 THEN 'undeclared grid' WHEN k % 7 = 0 THEN 'not north-up on the tile origin' WHEN p % 4 = 3 THEN 'unsupported resolution'
  WHEN k % 11 = 0 THEN 'shape differs' END AS reason FROM h""")
def _(spark, sf):
    reason = geo.asset_mismatch(F.col("transform"), F.col("shape"), F.lit(600_000.0), F.lit(4_000_020.0), F.lit(10_980), F.lit(10_980))
    return headers(spark, sf).select("k", "p", "s", "n", reason.alias("reason"))


@query("grid_origin_checks", "C12 C13 C14 C15 C16 A27", """WITH h AS (SELECT l_orderkey AS k, l_partkey AS p, l_suppkey AS s, l_linenumber AS n, [10, 20, 60, 30][CAST(l_partkey % 4 AS INT) + 1] AS res FROM lineitem)
SELECT k, p, s, n, round(CASE WHEN k % 7 = 0 THEN 5e0 / res ELSE 0e0 END, 9) AS col_offset, 0e0 AS row_offset, TRUE AS same_pixel_size, k % 11 <> 0 AS same_shape,
  k % 7 <> 0 AND k % 11 <> 0 AS aligned, CASE WHEN k % 7 = 0 THEN 'origin differs' WHEN k % 11 = 0 THEN 'shape differs' END AS mismatch FROM h""")
def _(spark, sf):
    h = headers(spark, sf)
    header = {"x0": F.col("x0"), "y0": F.lit(4_000_020.0), "pixel": F.col("res"), "rows": F.element_at("shape", 1), "cols": F.element_at("shape", 2), "epsg": F.lit(32617)}
    wanted = {"x0": F.lit(600_000.0), "y0": F.lit(4_000_020.0), "rows": F.col("cells"), "cols": F.col("cells"), "epsg": F.lit(32617)}
    checks = geo.origin_check(header, wanted, F.col("res"))
    return h.select(
        "k", "p", "s", "n", *[(c + 0.0 if name.endswith("offset") else c).alias(name) for name, c in checks.items()], geo.grid_mismatch(header, wanted).alias("mismatch")
    )


@query("tile_grid_shapes", "B57 B59", """SELECT o_orderkey AS k, CAST(10980 * 10 // r AS BIGINT) AS rows, (10980 + o_orderkey % 3 * 12) * 10 // r AS cols, 600000 + (10980 + o_orderkey % 3 * 12) * 10 AS east
FROM (SELECT *, [10, 20, 60][CAST(o_orderkey % 3 AS INT) + 1] AS r FROM orders)""")
def _(spark, sf):
    k = F.col("o_orderkey")
    res = F.element_at(F.array(F.lit(10), F.lit(20), F.lit(60)), (k % 3 + 1).cast("int"))
    width = F.lit(10_980) + k % 3 * 12
    rows, cols = geo.grid_shape(width, F.lit(10_980), res)
    bounds = geo.grid_bounds(F.lit(600_000), F.lit(4_000_020), width, F.lit(10_980))
    return load(spark, sf, "orders").select(k.alias("k"), rows.alias("rows"), cols.alias("cols"), bounds["east"].alias("east"))


@query("candidate_centers", "C19 B40", LAKES.split(",\ntiles AS")[0] + """ SELECT body, round(l + w / 2e0, 4) AS center_x, round(b + h / 2e0, 4) AS center_y,
  CASE WHEN w * h * 20 < 100000 THEN 'small' WHEN w * h * 20 < 1000000 THEN 'medium' ELSE 'large' END AS area_band FROM lakes""")
def _(spark, sf):
    from tarnscope.operators.selection import with_center

    rows = lakes(spark, sf)
    sizes = geo.polygon_measures(rows, ["body"]).select("body", (F.col("area") * 20).alias("area"))
    out = with_center(sizes, rows, ["body"], F.col("area"))
    return out.select("body", F.round("center_x", 4).alias("center_x"), F.round("center_y", 4).alias("center_y"), "area_band")
