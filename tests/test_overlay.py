import numpy as np
import pytest

from boskage.functions import geometry as G
from boskage.operators import overlay, raster, spatial_join


def square(x, y, w):
    return [[np.array([[x, y], [x + w, y], [x + w, y + w], [x, y + w]], float)]]


def star(rng, r, n):
    t, d = np.sort(rng.uniform(0, 2 * np.pi, n)), r * rng.uniform(0.5, 1, n)
    cx, cy = rng.uniform(0, 100, 2)
    return [[np.column_stack([700000 + cx + d * np.cos(t), 6600000 + cy + d * np.sin(t)])]]


def test_kernels_agree_with_the_sweep():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = star(rng, 80, 9), star(rng, 80, 12)
        if G.is_simple(a[0][0]) and G.is_simple(b[0][0]):
            both = G.overlap_area(a, b)
            assert abs(G.area(G.intersection(a, b)) - both) < 1e-3
            assert abs(G.area(G.union([a, b])) - (G.area(a) + G.area(b) - both)) < 1e-3
            assert abs(G.area(G.difference(a, b)) - (G.area(a) - both)) < 1e-3


def test_edges_along_each_other_holes_and_points():
    assert G.area(G.union([square(0, 0, 10), square(10, 0, 10)])) == 200 and len(G.union([square(0, 0, 10), square(10, 0, 10)])) == 1
    (ring,) = G.difference(square(0, 0, 10), square(3, 3, 3))
    assert len(ring) == 2 and G.area([ring]) == 91
    assert len(G.union([square(0, 0, 10), square(10, 10, 10)])) == 2  # they touch in a point
    assert G.difference(square(0, 0, 10), square(0, 0, 10)) == [] == G.intersection(square(0, 0, 1), square(5, 5, 1)) and G.union([]) == []


def test_distance_of_parts_and_holes():
    two = square(100, 0, 2) + square(3, 3, 1)
    assert G.distance(square(0, 0, 10), two) == 0.0 == G.distance(two, square(0, 0, 10))  # the second part lies inside
    ring = G.difference(square(0, 0, 10), square(2, 2, 6))
    assert G.distance(ring, square(4, 4, 2)) == 2.0 and np.isnan(G.distance([], ring))
    assert G.point_gaps(ring, np.array([1.0, 5.0, 12.0]), np.array([1.0, 5.0, 5.0])).tolist() == [0.0, 3.0, 2.0]


@pytest.mark.parametrize("most", [2, 200])
def test_dissolve(spark, most):
    rng = np.random.default_rng(4)
    grid, rows = {k: np.zeros((140, 140), bool) for k in ("a", None)}, []
    for i in range(60):
        x, y, w = (int(v) for v in (*rng.integers(0, 100, 2), rng.integers(1, 30)))
        k = "a" if i % 2 else None
        grid[k][x : x + w, y : y + w] = True
        rows += [(k, G.write_wkb(square(x, y, w)), float(x), float(y), float(x + w), float(y + w))] * (1 + i % 3)
    df = spark.createDataFrame([*rows, ("a", None, 0.0, 0.0, 1.0, 1.0)], "k string, geometry binary, minx double, miny double, maxx double, maxy double").selectExpr("*", "1 as tx", "2 as area")
    got = {r.k: round(r.area, 3) for r in overlay.dissolve(df.drop("tx"), ["k"], 20.0, most).groupBy("k").agg({"area": "sum"}).withColumnRenamed("sum(area)", "area").collect()}
    assert got == {k: g.sum() for k, g in grid.items()}
    assert overlay.dissolved_areas(df.limit(0), ["k"]).count() == 0


def test_overlaid_masked_and_merged(spark):
    table = lambda rows: spark.createDataFrame([(i, G.write_wkb(square(x, y, w)) if w else None, x, y, x + w, y + w) for i, x, y, w in rows], "id long, geometry binary, minx double, miny double, maxx double, maxy double")
    a, b = table([(1, 0.0, 0.0, 4.0), (2, 10.0, 0.0, 2.0), (3, 50.0, 50.0, 0.0)]), table([(7, 2.0, 2.0, 4.0), (8, 12.5, 0.0, 1.0), (9, 50.0, 50.0, 0.0)])
    cut = overlay.overlaid(a, b, 5.0).collect()
    assert [(r.l_id, r.r_id, G.area(G.read_wkb(r.geometry)[1])) for r in cut] == [(1, 7, 4.0)]
    assert [r.id for r in overlay.masked(a, b, "id", 5.0).collect()] == [1]
    assert sorted(r.id for r in overlay.merged(a, b, "id").collect()) == [1, 2, 3, 8]
    assert overlay.overlaid(a, b.limit(0), 5.0).count() == 0


def test_containing(spark):
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 4.5, 4.5), (3, None, 1.0)], "id long, x double, y double")
    ring = G.write_wkb([[*G.difference(square(0, 0, 5), square(4, 4, 0.8))[0]]])
    regions = spark.createDataFrame([(9, ring, 0.0, 0.0, 5.0, 5.0), (8, None, 0.0, 0.0, 9.0, 9.0)], "id long, geometry binary, minx double, miny double, maxx double, maxy double")
    assert [(r.l_id, r.r_id) for r in spatial_join.containing(points, regions, 2.0).collect()] == [(1, 9)]


def test_outlines_have_the_area_and_box_of_their_pixels(spark):
    rows = [(r, c, int((r * 7 + c * c) % 3 == 0)) for r in range(12) for c in range(12)]
    affine = (30.0, 0.0, 600000.0, 0.0, -30.0, 6700000.0)
    labelled = raster.regions(spark.createDataFrame(rows, "row int, col int, value int"), 12).cache()
    shapes = {r.region: r for r in raster.region_shapes(labelled, affine).collect()}
    found = raster.region_outlines(labelled, affine).collect()
    assert len(found) == len(shapes)
    for r in found:
        parts, want = G.read_wkb(r.geometry)[1], shapes[r.region]
        assert abs(G.area(parts) - want.area) < 1e-6 and G.bounds(parts) == (want.minx, want.miny, want.maxx, want.maxy)
        assert all(G.signed_area(p[0]) > 0 for p in parts)
