import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from boskage.functions import fuzzy, geometry, planar, profiles, temporal


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


def test_fixed_profiles(spark):
    x = lambda v: F.lit(float(v))
    assert value(spark, profiles.offset_gaussian(x(10), 10, 100)) == 1
    assert round(value(spark, profiles.offset_gaussian(x(110), 10, 100)), 6) == 0.135335
    assert round(value(spark, profiles.weighting_function(x(1000), 500, 500)), 6) == 0.5
    assert round(value(spark, profiles.profile(x(110), "hm", "Fire", "spatial")), 6) == 0.555713
    assert round(value(spark, profiles.profile(x(365), "hm", "Fire", "temporal")), 6) == 0.972980
    assert round(value(spark, profiles.profile(x(366), "hm", "Fire", "temporal")), 6) == 0.472836
    assert round(value(spark, profiles.profile(x(110), "senfseidl", "Fire", "spatial")), 6) == 0.772446
    args = (F.lit("hm"), F.lit("Fire"), F.lit("senfseidl"), F.lit("Fire"), "spatial")
    assert abs(value(spark, profiles.pair_weight(x(110), *args)) - (0.555713 + 0.772446) / 2) < 1e-6
    for d, classes in profiles.COMPOSITION.items():
        for c in classes:
            for kind in ("spatial", "temporal"):
                for v in (0, 30, 400, 3000):
                    a, b = spark.range(1).select(profiles.profile(x(v), d, c, kind), profiles.profile_of(x(v), F.lit(d), F.lit(c), kind)).first() if (d, v) in {("nfi", 400), ("bdiff", 30), ("cdi", 3000), ("hm", 400)} else (0, 0)
                    assert abs(a - b) < 1e-12
    assert value(spark, profiles.profile_of(x(1), F.lit("none"), F.lit("Fire"), "spatial")) == 0


def test_edge_weights(spark):
    w = lambda ds, dt, ra, rb, same: value(spark, profiles.edge_weight(F.lit(float(ds)), F.lit(float(dt)), F.lit(ra), F.lit(rb), F.lit(same), 1000, 180, 0.5, 6000))
    assert round(w(1000, 180, 0.9, 0.9, True), 6) == 0.060901
    assert round(w(500, 180, 1.0, 0.7, False), 6) == 0.189661
    assert w(6001, 0, 1.0, 1.0, False) == 0


def test_class_similarity():
    t = {r[:4]: r[4] for r in profiles.class_similarity_rows()}
    assert t["senfseidl", "Fire", "hm", "Fire"] == 0.935
    assert t["senfseidl", "Storm,Biotic", "hm", "Storm"] == 0.675
    assert t["nfi", "Other", "senfseidl", "Other"] == 0.885
    assert t["hm", "Fire", "hm", "Fire"] == 1 and all(t[a, b, c, d] == t[c, d, a, b] for a, b, c, d in t)


def test_days(spark):
    a, b = F.lit("2020-01-01 23:00:00").cast("timestamp_ntz"), F.lit("2020-01-02 01:00:00").cast("timestamp_ntz")
    assert value(spark, temporal.floor_days(a, b)) == 1 and value(spark, temporal.floor_days(b, a)) == 0
    assert str(value(spark, temporal.midpoint(a, b))) == "2020-01-02 00:00:00"


def test_linear_weights_and_clip(spark):
    assert round(value(spark, profiles.linear_spatial(F.lit(4.0))), 6) == 0.666667
    assert round(value(spark, profiles.linear_temporal(F.lit(2.0))), 6) == 0.833333
    assert value(spark, profiles.linear_temporal(F.lit(4.0))) == 0.5
    for v, want in ((float("nan"), 0), (None, 0), (2.0, 1), (-1.0, 0), (0.3, 0.3)):
        assert value(spark, profiles.clipped(F.lit(v).cast("double"))) == want


def test_rectangles(spark):
    r = lambda *v: dict(zip(("minx", "miny", "maxx", "maxy"), map(F.lit, map(float, v))))
    a, b = r(0, 0, 100, 100), r(50, 50, 150, 150)
    assert round(value(spark, planar.rect_iou(a, b)), 6) == 0.142857
    assert value(spark, planar.rect_distance(a, r(103, 104, 110, 110))) == 5
    assert value(spark, planar.rect_distance(a, b)) == 0


def test_projections(spark):
    lon, lat = F.lit(10.0), F.lit(52.0)
    e, n = spark.range(1).select(*planar.laea_europe(lon, lat)).first()
    assert abs(e - 4321000) < 1e-6 and abs(n - 3210000) < 1e-6
    e, n = spark.range(1).select(*planar.laea_europe(F.lit(5.0), F.lit(50.0))).first()
    assert abs(e - 3962799.45) < 0.01 and abs(n - 2999718.85) < 0.01
    e, n = spark.range(1).select(*planar.utm(F.lit(3.0), F.lit(45.0), 31)).first()
    assert abs(e - 500000) < 1e-6 and abs(n - 4982950.40) < 0.01
    x, y = spark.range(1).select(*planar.lambert93(F.lit(2.3522), F.lit(48.8566))).first()
    assert abs(x - 652469.02) < 0.01 and abs(y - 6862035.26) < 0.01
    x, y = spark.range(1).select(*planar.web_mercator(F.lit(180.0), F.lit(0.0))).first()
    assert abs(x - 20037508.342789) < 1e-3 and abs(y) < 1e-6


def sq(x, y, s):
    return [[np.array([[x, y], [x + s, y], [x + s, y + s], [x, y + s]], float)]]


def test_polygon_kernels():
    assert geometry.area(sq(0, 0, 100)) == 10000 and geometry.centroid(sq(0, 0, 100)) == (50, 50)
    assert abs(geometry.overlap_area(sq(0, 0, 100), sq(50, 50, 100)) - 2500) < 1e-6
    assert geometry.distance(sq(0, 0, 1), sq(4, 5, 1)) == 5 and geometry.distance(sq(0, 0, 10), sq(2, 2, 1)) == 0
    holed = [[sq(0, 0, 10)[0][0], sq(2, 2, 4)[0][0]]]
    assert geometry.area(holed) == 84 and geometry.distance(holed, sq(3, 3, 1)) == 1
    assert abs(geometry.overlap_area(holed, sq(0, 0, 5)) - 16) < 1e-9
    kind, parts = geometry.read_wkb(geometry.write_wkb(sq(1, 2, 3) + sq(9, 9, 1), geometry.MULTIPOLYGON))
    assert kind == geometry.MULTIPOLYGON and geometry.area(parts) == 10
    assert geometry.read_wkb(None) == (0, []) and geometry.read_wkb(b"\x01\x02") == (0, [])
    assert len(geometry.hull(np.array([[0, 0], [2, 0], [1, 1], [2, 2], [0, 2]]))) == 4
    assert geometry.simplify_line(np.array([[0, 0], [1, 0.1], [2, 0], [3, 5.0]]), 0.5).tolist() == [[0, 0], [2, 0], [3, 5]]
    assert abs(geometry.area(geometry.clip_box(sq(0, 0, 10), 5, 5, 20, 20)) - 25) < 1e-9
    assert geometry.is_simple(sq(0, 0, 1)[0][0]) and not geometry.is_simple(np.array([[0, 0], [1, 1], [1, 0], [0, 1.0]]))
    assert round(geometry.fractal_dimension(4, 5000), 6) == 0.325528 and round(geometry.fractal_dimension(12, 5000), 6) == 0.583504
    assert geometry.valid_clear_cut(sq(0, 0, 71)) and geometry.right_angle_pairs(sq(0, 0, 1)[0][0]) == 12
    a, b = geometry.normalise([[sq(0, 0, 2)[0][0][::-1]]]), geometry.normalise([[np.roll(sq(0, 0, 2)[0][0], 2, 0)]])
    assert (a[0][0] == b[0][0]).all()


@pytest.mark.parametrize("seed", range(5))
def test_overlap_against_sampling(seed):
    rng = np.random.default_rng(seed)
    star = lambda cx, cy: [[np.array([[cx + r * math.cos(t), cy + r * math.sin(t)] for t, r in zip(np.linspace(0, 2 * math.pi, 9)[:-1], rng.uniform(2, 6, 8))])]]
    a, b = star(0, 0), star(3, 1)
    p = rng.uniform(-8, 12, (200_000, 2))
    share = (geometry.contains_points(a, *p.T) & geometry.contains_points(b, *p.T)).mean() * 400
    assert abs(geometry.overlap_area(a, b) - share) < 0.6


def test_names():
    assert fuzzy.token_set_ratio("Scots Pine", "pine, scots") == 100
    assert fuzzy.token_set_ratio("Pine", "Scots Pine") == 100
    assert fuzzy.token_set_ratio("", "Pine") == 0 and fuzzy.token_set_ratio(None, None) == 0
    assert fuzzy.token_set_ratio("Box", "Boxes") == 75 and fuzzy.token_set_ratio("Yew", "Box") < 40
