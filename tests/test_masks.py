"""Coverage, classes and distances against a brute-force walk over every pixel."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tarnscope.operators import geometry as geo
from tarnscope.operators import masks as mk

X0, Y0, SIZE = 600_000.0, 3_800_000.0, 48


def star(cx, cy, radius, n, rng):
    """A simple polygon around its center: sorted angles, one radius per vertex."""
    angles = sorted((i + rng.uniform(0.1, 0.9)) * 2 * math.pi / n for i in range(n))
    radii = [radius * rng.uniform(0.45, 1) for _ in angles]
    pts = [(cx + r * math.cos(a), cy + r * math.sin(a)) for a, r in zip(angles, radii, strict=True)]
    return [*pts, pts[0]]


def clip(poly, low, high, axis):
    """Clip an open polygon to low <= axis <= high."""
    for bound, keep in ((low, lambda v: v >= low), (high, lambda v: v <= high)):
        out = []
        for i, p in enumerate(poly):
            q = poly[(i + 1) % len(poly)]
            if keep(p[axis]):
                out.append(p)
            if keep(p[axis]) != keep(q[axis]):
                t = (bound - p[axis]) / (q[axis] - p[axis])
                out.append(tuple(p[k] + t * (q[k] - p[k]) for k in (0, 1)))
        poly = out
        if not poly:
            return []
    return poly


def area(poly):
    """Shoelace area around the first vertex, which keeps precision at large coordinates."""
    if len(poly) < 3:
        return 0.0
    near = [(x - poly[0][0], y - poly[0][1]) for x, y in poly]
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(near, [*near[1:], near[0]], strict=True))) / 2


def segment_distance(px, py, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    length = dx * dx + dy * dy
    t = 0.0 if length == 0 else max(0.0, min(1.0, ((px - a[0]) * dx + (py - a[1]) * dy) / length))
    return math.hypot(px - a[0] - t * dx, py - a[1] - t * dy)


def inside(px, py, rings):
    hits = 0
    for ring in rings:
        for a, b in zip(ring, ring[1:], strict=False):
            if (a[1] <= py) != (b[1] <= py) and px < a[0] + (py - a[1]) * (b[0] - a[0]) / (b[1] - a[1]):
                hits += 1
    return hits % 2 == 1


def brute(parts):
    """Pixel to (class, coverage, distance) of a multipolygon given as lists of rings."""
    out = {}
    rings = [r for part in parts for r in part]
    for row in range(SIZE):
        for col in range(SIZE):
            west, north = X0 + col * 10, Y0 - row * 10
            covered = 0.0
            for part in parts:
                for i, ring in enumerate(part):
                    piece = clip(clip(ring[:-1], west, west + 10, 0), north - 10, north, 1)
                    covered += area(piece) * (1 if i == 0 else -1)
            covered /= 100
            px, py = west + 5, north - 5
            d = min(segment_distance(px, py, a, b) for r in rings for a, b in zip(r, r[1:], strict=False))
            cls = 1 if covered >= 1 - 1e-6 else 2 if covered > 1e-6 else 3 if d <= 100 else None
            if cls:
                signed = -d if cls < 3 and inside(px, py, rings) else d
                out[row, col] = (cls, max(covered, 0.0), signed if d <= 1000 else None)
    return out


def ring_rows(spark, bodies):
    rows = []
    for body, parts in bodies.items():
        for p, part in enumerate(parts):
            for r, ring in enumerate(part):
                rows.append((body, p, r, [tuple(map(float, pt)) for pt in ring]))
    df = spark.createDataFrame(rows, "body string, part int, ring int, pts array<struct<x:double,y:double>>")
    grid = {"resolution": F.lit(10.0), "x0": F.lit(X0), "y0": F.lit(Y0), "rows": F.lit(SIZE), "cols": F.lit(SIZE)}
    return df.withColumns(grid)


def shapes():
    rng = random.Random(7)
    at = lambda c, r: (X0 + c * 10, Y0 - r * 10)
    square = [at(10, 10), at(20, 10), at(20, 20), at(10, 20), at(10, 10)]
    hole = [at(13, 13), at(16, 13), at(16, 17), at(13, 17), at(13, 13)]
    return {
        "aligned": [[square]],
        "hole_same_winding": [[square, hole]],
        "hole_other_winding": [[square, hole[::-1]]],
        "pond": [[[at(5.2, 5.2), at(5.7, 5.3), at(5.5, 5.8), at(5.2, 5.2)]]],
        "star": [[star(*at(24, 24), 120, 11, rng)]],
        "star_hole": [[star(*at(22, 26), 160, 14, rng), star(*at(22, 26), 45, 7, rng)]],
        "over_left_edge": [[star(*at(1, 20), 90, 9, rng)]],
        "over_corner": [[star(*at(46, 46), 110, 12, rng)]],
        "two_parts": [[star(*at(8, 38), 50, 8, rng)], [star(*at(30, 10), 60, 8, rng)]],
    }


@pytest.fixture(scope="module")
def result(spark):
    rows = mk.mask_pixels(ring_rows(spark, shapes()), ["body"]).collect()
    out = {}
    for r in rows:
        out.setdefault(r.body, {})[r.row, r.col] = (r.pixel_class, r.coverage, r.edge_distance)
    return out


@pytest.mark.parametrize("body", sorted(shapes()))
def test_mask_matches_brute_force(result, body):
    want, got = brute(shapes()[body]), result.get(body, {})
    assert set(got) == set(want)
    for pixel, (cls, covered, distance) in want.items():
        assert got[pixel][0] == cls, pixel
        assert got[pixel][1] == pytest.approx(covered, abs=1e-9)
        assert got[pixel][2] == pytest.approx(distance, abs=1e-6), pixel


def test_coverage_sums_to_the_area(spark):
    rings = ring_rows(spark, {"s": shapes()["star_hole"]})
    edges = mk.pixel_edges(rings, ["body"], ("resolution", "x0", "y0", "rows", "cols"))
    total = mk.coverage(edges, ["body"]).agg(F.sum("coverage")).first()[0] * 100
    area_m2 = geo.polygon_measures(rings, ["body"]).first().area
    assert total == pytest.approx(area_m2, rel=1e-9)


def test_projection_against_published_points(spark):
    # Equator on a central meridian, and the CN Tower (17T 630084 4833438).
    rows = spark.createDataFrame([(3.0, 0.0, 32631), (-79.387139, 43.642567, 32617)], "lon double, lat double, epsg int")
    got = geo.project_vertices(rows, "lon", "lat", "epsg").select("x", "y").collect()
    assert got[0].x == pytest.approx(500_000, abs=1e-6) and got[0].y == pytest.approx(0, abs=1e-6)
    assert got[1].x == pytest.approx(630_084, abs=2) and got[1].y == pytest.approx(4_833_438, abs=2)


def test_share_of_a_concave_polygon_in_a_rectangle(spark):
    rings = ring_rows(spark, {"s": shapes()["star"], "h": shapes()["star_hole"]}).select("body", "part", "ring", "pts")
    tiles = spark.createDataFrame(
        [("t", X0 + 180.0, Y0 - 300.0, X0 + 260.0, Y0 - 200.0)], "tile string, west double, south double, east double, north double"
    )
    got = {r.body: r.in_tile for r in geo.tile_shares(rings, tiles, 1000.0).collect()}
    for body, name in (("s", "star"), ("h", "star_hole")):
        inside_area = whole = 0.0
        for i, ring in enumerate(shapes()[name][0]):
            piece = clip(clip(ring[:-1], X0 + 180, X0 + 260, 0), Y0 - 300, Y0 - 200, 1)
            sign = 1 if i == 0 else -1
            inside_area += sign * area(piece)
            whole += sign * area(ring[:-1])
        assert got[body] == pytest.approx(inside_area / whole, abs=2e-6)
