import numpy as np
import pytest

from boskage.functions.wkt import from_lambert93, location, locations, to_lambert93
from boskage.operators.proximity import Pivots, VantageTree, distance, located, near_locations, near_rows


def test_projection_round_trip_and_known_points():
    x, y = to_lambert93(np.array([3.0, 2.3522]), np.array([46.5, 48.8566]))
    assert abs(x[0] - 700000) < 1e-6 and abs(y[0] - 6600000) < 1e-6
    assert abs(x[1] - 652469.02) < 0.01 and abs(y[1] - 6862035.26) < 0.01
    lon, lat = from_lambert93(*to_lambert93(np.array([-4.2, 9.1]), np.array([42.1, 50.9])))
    assert np.allclose(lon, [-4.2, 9.1], atol=1e-10) and np.allclose(lat, [42.1, 50.9], atol=1e-10)


@pytest.mark.parametrize(
    ("text", "where"),
    [
        ("POINT (1 2)", (1, 2)),
        (" point ( 1.5  -2e1 ) ", (1.5, -20)),
        ("POINT Z (1 2 3)", (1, 2)),
        ("POINTZ(1 2 3)", (1, 2)),
        ("MULTIPOINT ((1 2))", (1, 2)),
        ("MULTIPOINT ((1 2), (3 4))", (2, 3)),
        ("MULTIPOINT (1 2, 3 4)", (2, 3)),
        ("POLYGON ((0 0, 4 0, 4 2, 0 2, 0 0))", (2, 1)),
        ("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (0 0, 2 0, 2 4, 0 4, 0 0))", (3, 2)),
        ("MULTIPOLYGON (((0 0, 2 0, 2 2, 0 2, 0 0)), ((10 0, 12 0, 12 2, 10 2, 10 0)))", (6, 1)),
        ("LINESTRING (0 0, 4 0)", (2, 0)),
        ("SRID=4326;POINT (3 46.5)", (700000, 6600000)),
    ],
)
def test_locations(text, where):
    x, y = locations([text])
    assert np.allclose([x[0], y[0]], where)


def test_no_location():
    x, _ = locations([None, "", "POINT EMPTY", "GEOMETRYCOLLECTION EMPTY", "POINT (a b)", "POLYGON EMPTY", "SRID=99;POINT (1 2)", "rubbish (", "POLYGON ((1 1))" * 2])
    assert np.isnan(x).all()
    assert location("POINT") is None


@pytest.mark.parametrize("metric", ["plane", "great_circle"])
def test_tree_and_cells_are_complete(metric):
    rng = np.random.default_rng(3)
    scale = 5000.0 if metric == "plane" else 0.05
    x, y = rng.normal(0, scale, 900), rng.normal(45 if metric == "great_circle" else 0, scale, 900)
    x[:200], y[:200] = x[0], y[0]
    r = 400.0
    want = distance(metric, x[:, None], y[:, None], x, y) <= r
    q, p = VantageTree(x, y, metric).within(x, y, r)
    assert len(q) == want.sum() and want[q, p].all()
    for step, apart in ((90, 0.0), (3, 0.0), (3, 2 * r)):
        net = Pivots(x[::step], y[::step], metric, apart)
        home, far = net.homes(x, y)
        assert np.allclose(far, distance(metric, x, y, net.x[home], net.y[home]))
        reach = np.full(len(net.x), -np.inf)
        np.maximum.at(reach, home, far)
        rows, cells = net.copies(x, y, r, reach)
        sent = np.zeros((len(x), len(net.x)), bool)
        sent[rows, cells] = True
        for a, b in zip(*np.nonzero(want)):
            assert sent[a, home[b]]


def test_copies_of_a_query_stay_constant_as_places_grow():
    rng = np.random.default_rng(8)
    share = []
    for n in (2_000, 20_000, 200_000):
        x, y = rng.uniform(0, 1e5, n), rng.uniform(0, 1e5, n)
        net = Pivots(x[: n // 500], y[: n // 500], "plane", 500.0)
        home, far = net.homes(x, y)
        reach = np.full(len(net.x), -np.inf)
        np.maximum.at(reach, home, far)
        share.append(len(net.copies(x, y, 250.0, reach)[0]) / n)
    assert max(share) < 3


def test_rows(spark):
    rng = np.random.default_rng(5)
    pts = [(int(i), "hm" if i % 3 else "nfi", f"POINT ({rng.integers(0, 60) * 50} {rng.integers(0, 60) * 50})") for i in range(700)]
    pts += [(700 + i, "hm" if i % 2 else "nfi", "POINT (100 100)") for i in range(60)] + [(900, "hm", None), (901, "nfi", "POINT EMPTY"), (902, None, "POINT (1 1)")]
    df = spark.createDataFrame(pts, "row_id long, ds string, geometry string").selectExpr("*", "0 as x", "1 as cell")
    places = located(df, "row_id", "geometry", "ds").cache()
    h, n = places.where("side = 'hm'"), places.where("side = 'nfi'")
    H, N = h.toPandas(), n.toPandas()
    want = {(a, b) for a, ax, ay in zip(H.row, H.x, H.y) for b in N.row[np.hypot(N.x - ax, N.y - ay) <= 250]}
    for how in ({}, {"pivots": 5, "part": 40}, {"cell": 2, "part": 1}):
        got = near_rows(h, n, 250.0, **how).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert near_rows(h, n.limit(0), 250.0).count() == 0
    assert near_rows(h.limit(0), n, 250.0).count() == 0


def test_great_circle_rows(spark):
    rng = np.random.default_rng(6)
    lon, lat = rng.uniform(179.9, 180.1, 400), rng.uniform(60, 60.1, 400)
    lon = np.where(lon > 180, lon - 360, lon)
    df = spark.createDataFrame([(int(i), float(a), float(b)) for i, (a, b) in enumerate(zip(lon, lat))], "row long, x double, y double")
    got = {tuple(r) for r in near_rows(df.where("row % 2 = 0"), df.where("row % 2 = 1"), 900.0, "great_circle", cell=20).collect()}
    d = distance("great_circle", lon[:, None], lat[:, None], lon, lat)
    assert got == {(i, j) for i, j in zip(*np.nonzero(d <= 900)) if i % 2 == 0 and j % 2 == 1}
    assert near_locations(df, df, 1e9, "great_circle").count() == 160_000
