"""Polygon and grid geometry as column expressions.

A polygon is a set of ring rows ``(body, part, ring, pts)`` where ``pts`` is a closed array of
``struct<x, y>`` and ring 0 is the outer one. Per-ring measures use array functions inside the
row; per-edge work explodes the ring once. No window over vertices is needed.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnscope.functions.scalars import rounded

EARTH_RADIUS_M = 6_371_008.8
RESOLUTIONS = (10, 20, 60)
# WGS84 ellipsoid and the UTM scale factor.
SEMI_MAJOR, FLATTENING, UTM_SCALE = 6_378_137.0, 1 / 298.257223563, 0.9996


# ------------------------------------------------------------------ projection


def _series() -> tuple[float, list[float], float]:
    """Krueger-series constants from the third flattening, to fourth order."""
    n = FLATTENING / (2 - FLATTENING)
    radius = SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    ]
    return radius, alpha, 2 * math.sqrt(n) / (1 + n)


def to_utm(lon: Column, lat: Column, epsg: Column) -> tuple[Column, Column]:
    """WGS84 degrees to UTM metres of the zone an EPSG code names, sub-millimetre in-zone."""
    radius, alpha, e = _series()
    zone = F.pmod(epsg, F.lit(100))
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - F.lit(e) * F.atanh(F.lit(e) * s))
    xi = F.atan2(t, F.cos(lam))
    eta = F.atanh(F.sin(lam) / F.sqrt(F.lit(1.0) + t * t))
    east, north = eta, xi
    for j, a in enumerate(alpha, start=1):
        east = east + F.lit(a) * F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j))
        north = north + F.lit(a) * F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j))
    shift = F.when(epsg >= 32700, 10_000_000.0).otherwise(0.0)
    scale = UTM_SCALE * radius
    return F.lit(500_000.0) + east * scale, north * scale + shift


def project_vertices(vertices: DataFrame, lon: str, lat: str, epsg: str) -> DataFrame:
    """Vertices in UTM metres. A vertex that does not project is an error."""
    x, y = to_utm(F.col(lon), F.col(lat), F.col(epsg))
    bad = F.isnan(x) | F.isnan(y)
    fail = F.raise_error(F.lit("vertex does not project")).cast("double")
    return vertices.withColumns({"x": F.when(bad, fail).otherwise(x), "y": F.when(bad, fail).otherwise(y)})


def local_plane(lon: Column, lat: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    """Metres on an equirectangular plane around a reference point."""
    k = EARTH_RADIUS_M * math.pi / 180
    return (lon - lon0) * k * F.cos(F.radians(lat0)), lat * k


# ------------------------------------------------------------------ rings and edges


def edge_array(pts: Column) -> Column:
    index = F.sequence(F.lit(1), F.size(pts) - 1)
    return F.transform(
        index,
        lambda i: F.struct(
            F.element_at(pts, i).x.alias("x1"), F.element_at(pts, i).y.alias("y1"),
            F.element_at(pts, i + 1).x.alias("x2"), F.element_at(pts, i + 1).y.alias("y2"),
        ),
    )


def spread(rows: DataFrame, keys: Sequence[str], work: Column, each: int, whole: bool = False) -> DataFrame:
    """Rows dealt over tasks by the rows they will grow to, ``work``, at most about ``each`` a task.

    A small file is read by one task, and Spark sizes partitions by bytes before an explode, so without this
    one task does the work of all. The number is explicit, so that AQE does not join the partitions again.
    ``whole`` keeps the rows of a key together, which spares later shuffles by it; otherwise what grows out of
    a key may still be dealt further.
    """
    total = rows.agg(F.sum(work)).first()[0] or 0
    by = [F.col(k) for k in keys]
    return rows.repartition(max(1, math.ceil(total / each)), *(by if whole else [F.xxhash64(*by)]))


def by_shuffle(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the polygons. Spark's estimate does not count the rows an explode adds, so
    it would take the side for small and send it whole through the driver."""
    return side.hint("merge")


def signed_area(pts: Column) -> Column:
    """Shoelace area of a closed ring, positive counter-clockwise. Coordinates are taken
    relative to the first vertex, which keeps precision for large projected values."""
    x0, y0 = F.element_at(pts, 1).x, F.element_at(pts, 1).y
    total = F.aggregate(
        edge_array(pts),
        F.lit(0.0),
        lambda acc, e: acc + (e.x1 - x0) * (e.y2 - y0) - (e.x2 - x0) * (e.y1 - y0),
    )
    return F.when(F.size(pts) >= 4, total / 2).otherwise(F.lit(0.0))


def ring_areas(rings: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rings.select(*keys, "part", "ring", F.abs(signed_area(F.col("pts"))).alias("area"))


def polygon_measures(rings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Area (holes removed, parts never negative), bounding box and vertex count per polygon."""
    area = F.abs(signed_area(F.col("pts")))
    xs, ys = F.col("pts.x"), F.col("pts.y")
    per_part = rings.groupBy(*keys, "part").agg(
        F.sum(F.when(F.col("ring") == 0, area).otherwise(-area)).alias("_area"),
        F.min(F.array_min(xs)).alias("_w"), F.min(F.array_min(ys)).alias("_s"),
        F.max(F.array_max(xs)).alias("_e"), F.max(F.array_max(ys)).alias("_n"),
        F.sum(F.size("pts")).alias("_v"),
    )
    return per_part.groupBy(*keys).agg(
        F.sum(F.greatest("_area", F.lit(0.0))).alias("area"),
        F.min("_w").alias("west"), F.min("_s").alias("south"), F.max("_e").alias("east"), F.max("_n").alias("north"),
        F.sum("_v").alias("vertices"),
    )


def boundary_edges(rings: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Every boundary edge of every ring, with the ring's fill direction.

    ``turn`` is +1 or -1 so that outer rings add and holes remove area whatever way the source
    wound them.
    """
    area = signed_area(F.col("pts"))
    want = F.when(F.col("ring") == 0, 1.0).otherwise(-1.0)
    turned = rings.withColumn("turn", want * F.signum(area))
    return turned.select(*keep, "part", "ring", "turn", F.inline(edge_array(F.col("pts"))))


def edges_from_vertices(vertices: DataFrame, keys: Sequence[str], pos: str) -> DataFrame:
    """Edges from a long vertex table by an equi-join of each position to the next one, which
    spreads a ring of any length over all tasks."""
    nxt = vertices.select(*keys, (F.col(pos) - 1).alias(pos), F.col("x").alias("x2"), F.col("y").alias("y2"))
    here = vertices.withColumnsRenamed({"x": "x1", "y": "y1"})
    return here.join(nxt, [*keys, pos])


def densify(edges: DataFrame, spacing: float) -> DataFrame:
    """Split every edge into equal pieces no longer than the spacing."""
    length = F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2))
    n = F.greatest(F.lit(1), F.ceil(length / spacing).cast("int"))
    pieces = edges.withColumn("_n", n).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))

    def at(a: str, b: str, i: Column) -> Column:
        t = i / F.col("_n")
        return F.when(i == 0, F.col(a)).when(i == F.col("_n"), F.col(b)).otherwise(
            F.col(a) + (F.col(b) - F.col(a)) * t
        )

    i, j = F.col("_i"), F.col("_i") + 1
    return pieces.withColumns(
        {"_x1": at("x1", "x2", i), "_y1": at("y1", "y2", i), "_x2": at("x1", "x2", j), "_y2": at("y1", "y2", j)}
    ).drop("x1", "y1", "x2", "y2", "_n", "_i").withColumnsRenamed(
        {"_x1": "x1", "_y1": "y1", "_x2": "x2", "_y2": "y2"}
    )


def round_points(pts: Column, decimals: int) -> Column:
    """Round nested coordinates and drop any third dimension."""
    return F.transform(pts, lambda p: F.struct(F.round(p.x, decimals).alias("x"), F.round(p.y, decimals).alias("y")))


def geometry_digest(pts: Column) -> Column:
    return F.sha2(F.to_json(pts), 256)


# ------------------------------------------------------------------ share inside a rectangle


def rectangle_share_terms(west: Column, south: Column, east: Column, north: Column) -> Column:
    """One edge's contribution to the area of its polygon inside a rectangle.

    The edge is cut to the rectangle's y range, and x is clamped to its x range; the clamped
    edge is constant, linear, then constant, so its integral over y is closed-form. Summed over
    a polygon's edges (times ``turn``) this is the exact intersection area, concave or not.
    """
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    ya, yb = F.least(F.greatest(y1, south), north), F.least(F.greatest(y2, south), north)
    dy = yb - ya
    slope = F.try_divide(x2 - x1, y2 - y1)
    xa, xb = x1 + slope * (ya - y1), x1 + slope * (yb - y1)
    dx = xb - xa

    def clamp(x: Column) -> Column:
        return F.least(F.greatest(x, west), east)

    def unit(t: Column) -> Column:
        return F.coalesce(F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))

    ta, tb = unit(F.try_divide(west - xa, dx)), unit(F.try_divide(east - xa, dx))
    lo, hi = F.least(ta, tb), F.greatest(ta, tb)
    middle = (clamp(xa + dx * lo) + clamp(xa + dx * hi)) / 2
    integral = lo * clamp(xa) + (hi - lo) * middle + (1 - hi) * clamp(xb) - west
    return F.when(dy == 0, F.lit(0.0)).otherwise(dy * integral)


def tile_shares(rings: DataFrame, tiles: DataFrame, cell: float, buffer: float = 0.0) -> DataFrame:
    """Share of every polygon inside every tile its buffered bounding box meets.

    ``tiles`` has ``tile, west, south, east, north``. Both sides are put in square cells and
    matched cell by cell, so that no body is compared with a tile far away.
    """
    measures = polygon_measures(rings, ["body"])

    def cells(w: Column, s: Column, e: Column, n: Column) -> list[Column]:
        return [
            F.sequence(F.floor(w / cell), F.floor(e / cell)), F.sequence(F.floor(s / cell), F.floor(n / cell))
        ]

    gx, gy = cells(F.col("west") - buffer, F.col("south") - buffer, F.col("east") + buffer, F.col("north") + buffer)
    bodies = measures.withColumn("_gx", F.explode(gx)).withColumn("_gy", F.explode(gy))
    tx, ty = cells(F.col("t_west"), F.col("t_south"), F.col("t_east"), F.col("t_north"))
    renamed = tiles.select(
        "tile", *[F.col(c).alias(f"t_{c}") for c in ("west", "south", "east", "north")],
        *[F.col(c) for c in tiles.columns if c not in ("tile", "west", "south", "east", "north")],
    )
    placed = renamed.withColumn("_gx", F.explode(tx)).withColumn("_gy", F.explode(ty))
    meets = (
        (F.col("west") - buffer < F.col("t_east")) & (F.col("east") + buffer > F.col("t_west"))
        & (F.col("south") - buffer < F.col("t_north")) & (F.col("north") + buffer > F.col("t_south"))
    )
    extra = [c for c in renamed.columns if c not in ("tile", "t_west", "t_south", "t_east", "t_north")]
    keep = ["tile", "t_west", "t_south", "t_east", "t_north", *extra]
    pairs = bodies.join(placed, ["_gx", "_gy"]).where(meets).select("body", "area", *keep).distinct()
    edges = boundary_edges(pairs.join(rings, "body"), ["body", "area", *keep])
    term = rectangle_share_terms(*(F.col(f"t_{c}") for c in ("west", "south", "east", "north")))
    inside = edges.groupBy("body", "area", "tile", *extra).agg(F.abs(F.sum(term * F.col("turn"))).alias("inside"))
    share = F.when(F.col("area") > 0, rounded(F.col("inside") / F.col("area"), 6)).otherwise(F.lit(0.0))
    return inside.select("body", "tile", *extra, share.alias("in_tile"))


def point_in_tiles(points: DataFrame, tiles: DataFrame, cell: float, how: str = "inner") -> DataFrame:
    """Tiles whose rectangle holds a point, matched by square cells first. With ``how`` left, a point that no tile
    holds stays, without a tile."""
    located = points.withColumns({"_gx": F.floor(F.col("x") / cell), "_gy": F.floor(F.col("y") / cell)})
    placed = tiles.withColumn(
        "_hx", F.explode(F.sequence(F.floor(F.col("west") / cell), F.floor(F.col("east") / cell)))
    ).withColumn("_hy", F.explode(F.sequence(F.floor(F.col("south") / cell), F.floor(F.col("north") / cell))))
    inside = (
        (F.col("x") >= F.col("west")) & (F.col("x") < F.col("east")) & (F.col("y") >= F.col("south")) & (F.col("y") < F.col("north"))
    )
    return located.join(placed, (F.col("_gx") == F.col("_hx")) & (F.col("_gy") == F.col("_hy")) & inside, how).drop("_gx", "_gy", "_hx", "_hy")


def assign_primary_tile(shares: DataFrame, body: str, tile: str, same_zone: str, share: str, margin: float = 0.01) -> DataFrame:
    """One fixed tile per body and the role of every other: same zone first, then the largest
    share, shares within the margin tie, and the smaller tile id wins.

    The tiles of one body are few (those that can cover it), so they are gathered in its row
    and ranked there.
    """
    row = F.struct(F.col(tile).alias("t"), F.col(same_zone).alias("z"), F.col(share).alias("s"))
    grouped = shares.groupBy(body).agg(F.collect_list(row).alias("_all"))
    zone = F.array_max(F.transform("_all", lambda r: r.z.cast("int"))).alias("z")
    grouped = grouped.select(body, "_all", zone)
    pool = F.filter("_all", lambda r: r.z.cast("int") == F.col("z"))
    grouped = grouped.select(body, "_all", pool.alias("_pool"))
    best = F.array_max(F.transform("_pool", lambda r: r.s))
    tied = F.filter("_pool", lambda r: F.round(F.col("_best") - r.s, 9) <= margin)
    grouped = grouped.select(body, "_all", "_pool", best.alias("_best"))
    primary = F.array_min(F.transform(tied, lambda r: r.t)).alias("_primary")
    roles = grouped.select(body, "_all", primary).select(body, "_primary", F.explode("_all").alias("r"))
    role = F.when(F.col("r.t") == F.col("_primary"), "primary").otherwise("overlap")
    return roles.select(body, F.col("r.t").alias(tile), F.col("r.s").alias(share), role.alias("role"))


# ------------------------------------------------------------------ grids


def grid_shape(width_10m: Column, height_10m: Column, resolution: Column) -> tuple[Column, Column]:
    """Rows and columns at a resolution. One that does not nest is an error."""
    nests = (F.pmod(height_10m * 10, resolution) == 0) & (F.pmod(width_10m * 10, resolution) == 0)
    fail = F.raise_error(F.lit("resolution does not nest in the grid")).cast("bigint")

    def cells(n: Column) -> Column:
        return F.when(nests, F.floor(n * 10 / resolution)).otherwise(fail)

    return cells(height_10m), cells(width_10m)


def grid_bounds(x0: Column, y0: Column, width_10m: Column, height_10m: Column) -> dict[str, Column]:
    return {"west": x0, "south": y0 - height_10m * 10, "east": x0 + width_10m * 10, "north": y0}


def window_for(bounds: dict[str, Column], x0: Column, y0: Column, rows: Column, cols: Column, resolution: Column, margin: float) -> dict[str, Column]:
    """Pixel window of a bounding box plus a margin, clipped to the tile."""
    across = {"width": (bounds["west"] - x0, bounds["east"] - x0, cols, "col_off"), "height": (y0 - bounds["north"], y0 - bounds["south"], rows, "row_off")}
    out = {}
    for extent, (near, far, limit, offset) in across.items():
        first = F.greatest(F.floor((near - margin) / resolution), F.lit(0))
        out |= {offset: first, extent: F.greatest(F.least(F.ceil((far + margin) / resolution), limit) - first, F.lit(0))}
    return out


def grid_mismatch(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Why two grids differ, null when they do not."""
    return (
        F.when(~a["epsg"].eqNullSafe(b["epsg"]), "crs differs")
        .when((F.abs(a["x0"] - b["x0"]) > 1e-6) | (F.abs(a["y0"] - b["y0"]) > 1e-6), "origin differs")
        .when((a["rows"] != b["rows"]) | (a["cols"] != b["cols"]), "shape differs")
    )


def asset_mismatch(transform: Column, shape: Column, x0: Column, y0: Column, width_10m: Column, height_10m: Column) -> Column:
    """Why an asset's declared grid does not nest in the tile grid, null when it does."""
    a, c, e, f = (F.element_at(transform, i) for i in (1, 3, 5, 6))
    resolution = a.cast("int")
    rows, cols = (F.floor(n * 10 / resolution) for n in (height_10m, width_10m))
    return (
        F.when(transform.isNull() | shape.isNull(), "undeclared grid")
        .when((a <= 0) | (e != -a) | (c != x0) | (f != y0), "not north-up on the tile origin")
        .when((resolution != a) | ~resolution.isin(*RESOLUTIONS), "unsupported resolution")
        .when((F.element_at(shape, 1) != rows) | (F.element_at(shape, 2) != cols), "shape differs")
    )


def origin_check(header: dict[str, Column], expected: dict[str, Column], resolution: Column, tolerance: float = 1e-6) -> dict[str, Column]:
    """Origin offset in pixels, pixel size and shape agreement, and an aligned flag."""
    dx = (header["x0"] - expected["x0"]) / resolution
    dy = (header["y0"] - expected["y0"]) / -resolution
    size = (F.abs(header["pixel"] - resolution) < 1e-9)
    shape = (header["rows"] == expected["rows"]) & (header["cols"] == expected["cols"])
    return {
        "col_offset": F.round(dx, 9), "row_offset": F.round(dy, 9), "same_pixel_size": size, "same_shape": shape,
        "aligned": size & shape & (F.abs(dx) <= tolerance) & (F.abs(dy) <= tolerance),
    }
