from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from boskage.operators import extent, graph, raster, relational, sampling, votes
from boskage.operators.spatial_join import adaptive_pairs, meeting, nearest, strict_pairs, with_box
from boskage.plans import attribution, preprocess
from boskage.plans.carriers import events
from boskage.streaming.reference import anchor, anchored_counts

SF = "/root/testdata/sf0.001"


def test_report_classes(spark):
    rows = [("Feu de forêt", "x"), ("Dégât de feu", "Dégât d'origine entomologique"), ("Coup de vent fort", "x"), ("Sécheresse et feu vif", "x"), ("Souvent malade", "x"), (None, "Dégât dû à des végétaux")]
    df = spark.createDataFrame(rows, "p string, k string").select(preprocess.report_class(F.col("p"), F.col("k")))
    assert [r[0] for r in df.collect()] == ["Fire", "Biotic", "Storm", "Drought-dieback", "Storm", "Biotic"]


def test_process_hm(spark):
    cols = "`Année d'observation` int, `Sévérité` int, `LIB_Problème principal` string, `LIB_Type de problème` string, `LIB_Essence regroupée (ess. concernée)` string, `LIB_Feuillus/Résineux (ess. concernée)` string, Remarques string, Longitude double, Latitude double"
    ok = (2012, 4, "scolytes", "Dégât d'origine entomologique", "Épicéas", "Conifère", "vu", 3.0, 46.5)
    rows = [ok, (2012, 1, *ok[2:]), (*ok[:3], "autre", *ok[4:]), (*ok[:6], None, *ok[7:]), (2013, 3, *ok[2:])]
    got = sorted(preprocess.process_hm(spark.createDataFrame(rows, cols)).collect(), key=lambda r: r.year)
    assert [(r.year, r["class"], r.essence, r.tree_type, round(r.cx), round(r.cy)) for r in got] == [
        (2012, "Biotic-mortality", "Spruces", "conifer", 700000, 6600000), (2013, "Biotic-dieback", "Spruces", "conifer", 700000, 6600000)]


def test_forest_names(spark):
    df = spark.createDataFrame([("Châtaignier",), ("Ch�taignier",), ("ChÃ¢taignier",), ("Sapin, épicéa",), ("Mixte",), ("inconnu",), (None,)], "ESSENCE string")
    got = [(r.essence, r.tree_type) for r in preprocess.process_bdforet(df.withColumnRenamed("ESSENCE", "ESSENCE")).select("essence", "tree_type").collect()]
    assert got == [("chestnut", "Broadleaf")] * 3 + [("fir, spruce", "Conifer"), ("mixed", "Mixed"), (None, None), (None, None)]


def test_inventory_scores(spark):
    names = ["NINCID", "DC", "PRELEV5", "VEGET", "ACCI", "OBSVEGET", "MORTB", "DPYR", "SFGUI", "SFCOEUR", "SFDORGE", "VEGET5", "HUMUS", "GEST", "ELAG", "DEF5", "INCID", "CAMPAGNE", "DATEMORT"]
    row = lambda **kw: tuple(kw.get(n) for n in names)
    df = spark.createDataFrame([row(NINCID="1", VEGET="5", INCID="2", CAMPAGNE="2010", DATEMORT="1"), row(), row(NINCID="0", DC="3", CAMPAGNE="2011", DATEMORT="2"), row(NINCID="2", CAMPAGNE="2012")], ", ".join(f"{n} string" for n in names))
    got = preprocess.classify_inventory(df).collect()
    assert [r["class"] for r in got] == ["Fire", None, "Tree-logging", "Biotic-mortality"]
    assert [round(r.probability, 6) for r in got] == [1.0, 0.0, 1.0, 1.0]
    by = preprocess.classify_inventory_by_incident(df).collect()
    assert [(r["class"], r.start_date, r.end_date) for r in by] == [("Fire", date(2005, 1, 1), date(2010, 12, 28)), ("Other", None, None), ("Anthropogenic", None, date(2006, 12, 28)), ("Mortality", None, date(2012, 12, 28))]


def test_fire_polygons_and_bdiff(spark):
    inv = spark.createDataFrame([("a", 2012, "01", "V", "2012-07-03", 1, 9000.0, None), ("b", 2013, "02", "W", "2013-07-03", 2, 10.0, "Pin")], "UID string, annee int, code_insee string, nom_de_la_commune string, date_de_premiere_alerte string, numero int, surface_foret_m2 double, type_de_peuplement string")
    got = preprocess.process_firepolygons(inv, spark.createDataFrame([("a", b"x")], "UID string, geometry binary")).collect()
    assert [(r.uuid, r.name) for r in got] == [("2012_01_V_2012-07-03_1", "V")]
    fires = spark.createDataFrame([("u", 2012, 9000.0, True, 0.0, 0.0, 1.0, 1.0), ("u", 2012, 8000.0, False, 0.0, 0.0, 1.0, 1.0), ("w", 2012, 100.0, True, 0.0, 0.0, 1.0, 1.0)], "uuid string, year int, forest_area_m2 double, keep boolean, minx double, miny double, maxx double, maxy double").withColumns({"essence": F.lit(None).cast("string"), "tree_type": F.lit(None).cast("string")})
    forest = spark.createDataFrame([(0.0, 0.0, 2.0, 2.0, "Conifer", "fir"), (0.5, 0.5, 2.0, 2.0, "Broadleaf", "NR"), (9.0, 9.0, 10.0, 10.0, "Conifer", "yew")], "minx double, miny double, maxx double, maxy double, tree_type string, essence string")
    (r,) = preprocess.process_bdiff(fires, forest).collect()
    assert (r.uuid, r.forest_area_m2, r.tree_type, r.essence, r["class"]) == ("u", 9000.0, "Mixed", "fir", "Fire")


def pixels(spark, grid, **extra):
    a = np.array(grid)
    rows = [(int(i), int(j), int(a[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1])]
    return spark.createDataFrame(rows, "row int, col int, value int").withColumns({k: F.lit(v) for k, v in extra.items()})


AFFINE = (30.0, 0.0, 0.0, 0.0, -30.0, 300.0)


def test_rasters(spark):
    year = pixels(spark, [[5, 5, 0], [6, 5, 0], [6, 6, 5]])
    cause = pixels(spark, [[1, 1, 1], [2, 1, 1], [2, 0, 3]])
    got = {(r.year, r["class"], r.area) for r in preprocess.process_senfseidl(cause, year.where("value > 0"), AFFINE, 3).collect()}
    assert got == {(5, "Storm,Biotic", 2700.0), (6, "Fire", 1800.0), (5, "Other", 900.0)}
    h = pixels(spark, [[1000, 1000], [900, 3000]], year=2018).unionByName(pixels(spark, [[400, 501], [401, 100]], year=2019)).unionByName(pixels(spark, [[400, 0], [401, 100]], year=2020))
    forms = preprocess.process_forms(h, AFFINE, 2).collect()
    assert sorted((r.year, r.area, str(r.start_date), str(r.end_date)) for r in forms) == [(2018, 900.0, "2018-09-01", "2019-05-01"), (2018, 900.0, "2018-09-01", "2019-05-01"), (2019, 900.0, "2019-09-01", "2020-05-01")]
    frames = pixels(spark, [[7, 7], [0, 8]], frame_date=date(2012, 1, 10)).unionByName(pixels(spark, [[7, 0], [0, 0]], frame_date=date(2012, 1, 20)))
    assert sorted((str(r.start_date), r.area) for r in preprocess.process_cdi(frames, AFFINE, 2).collect()) == [("2012-01-10", 900.0), ("2012-01-10", 1800.0), ("2012-01-20", 900.0)]
    for h1, h2, want in ((1000, 400, True), (1000, 501, False), (900, 401, False), (32767, 100, False)):
        one = lambda v: spark.createDataFrame([(0, 0, v)], "row int, col int, value int")
        assert raster.clear_cut(one(h1), one(h2)).first()["cut"] is want
    series = [(0, 0, k, 3 if k < 5 else 4 if k >= 40 and k < 45 else 0) for k in range(76)] + [(0, 1, k, 3 if k < 4 else 4 if 40 <= k < 45 else 0) for k in range(76)]
    fr = spark.createDataFrame(series, "row int, col int, frame int, value int")
    assert {(r["col"], r.recovered) for r in raster.drought_recovery(fr, 71, 36).collect()} == {(0, True), (1, False)}
    assert raster.evaluation_windows(144) == [(18, 54), (54, 90)]


def test_votes(spark):
    m = spark.createDataFrame([(1, "k", "Fire", 0.7), (2, "k", "Fire", 1.0), (3, "k", "Storm", 0.9)], "uid long, cluster string, class string, r double")
    got = {r["class"]: round(r.p, 6) for r in votes.cluster_votes(m, m.where("uid = 1")).collect()}
    assert got == {"Fire": 0.679715, "Storm": 0.320285}
    assert votes.as_map(votes.cluster_votes(m, m)).count() == 3
    g = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (1, None), (2, "a"), (2, None), (2, None), (2, None), (3, None)], "g int, v string")
    assert {r.g: r.mode for r in votes.thresholded_mode(g, "g", "v").collect()} == {1: "a", 2: None, 3: None}
    e = spark.createDataFrame([(1, "fire", 0.9, 0), (1, "storm", 0.1, 1), (1, "storm", 0.1, 2)], "g int, c string, w double, seq int")
    assert votes.predominant(e, "g", "c", F.col("w")).first().c == "storm"
    t = spark.createDataFrame([(1, "Fire", 0.6), (1, "Storm", 0.25), (2, "Fire", 0.6)], "g int, c string, p double")
    assert {r.g: round(r.spread, 6) for r in votes.top_class(t, "g", "c", "p").collect()} == {1: 0.35, 2: 0.0}


def test_spatial_edges(spark):
    pts = lambda rows: with_box(spark.createDataFrame(rows, "uid long, x double, y double"))
    got = nearest(pts([(1, 1.0, 0.0), (2, 50.0, 0.0)]), pts([(10, 0.0, 0.0), (12, 2.0, 0.0), (19, 9.0, 0.0)]), "uid", 2.0).collect()
    assert {(r.l_uid, r.r_uid, r.sd) for r in got} == {(1, 10, 1.0), (1, 12, 1.0)}
    rng = np.random.default_rng(2)
    rows = [(int(k), *map(float, (x, y, x + w, y + h))) for k, (x, y, w, h) in enumerate(zip(*rng.uniform(-50, 50, (2, 150)), *rng.exponential(15, (2, 150))))]
    df = spark.createDataFrame(rows, "uid long, minx double, miny double, maxx double, maxy double")
    want = {(a[0], b[0]) for a in rows for b in rows if a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4]}
    for levels in (1, 3):
        pairs = meeting(df, df, 7.0 if levels == 1 else 0.5, levels).collect()
        assert len(pairs) == len(want) and {(r.l_uid, r.r_uid) for r in pairs} == want
    nulls = spark.createDataFrame([(1, None, 0.0, 1.0, 1.0), (2, float("nan"), 0.0, 1.0, 1.0)], df.schema)
    assert meeting(nulls, df, 7.0).count() == 0
    day = 86_400_000_000
    ev = with_box(spark.createDataFrame([(1, 0.0, 0.0, 0), (2, 5.0, 0.0, 0), (3, 30.0, 0.0, 0), (4, 500.0, 0.0, 0)], "uid long, x double, y double, mid_us long"))
    assert {(r.src, r.dst) for r in adaptive_pairs(ev, 8.0, 10).collect()} == {(1, 2), (2, 3), (1, 3), (1, 4), (2, 4), (3, 4)}  # 4 looks on until it finds others
    assert day


def test_adaptive_pairs_are_not_broadcast(spark, tmp_path):
    # a side is copied to many cells and spans, which no estimate of its size knows: sent to the driver, it fills it
    rng = np.random.default_rng(5)
    rows = [(int(k), float(x), float(y), int(t) * 3600_000_000) for k, (x, y, t) in enumerate(zip(*rng.uniform(0, 400, (2, 120)), rng.integers(0, 24 * 60, 120)))]
    rows += [(k, 60.0 * k, 0.0, 0) for k in (200, 201)]
    with_box(spark.createDataFrame(rows, "uid long, x double, y double, mid_us long")).write.parquet(f"{tmp_path}/ev")
    ev = spark.read.parquet(f"{tmp_path}/ev")  # a small file, of which the size is known
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan(strict_pairs(ev, 8.0, 10))
    pairs = adaptive_pairs(ev, 8.0, 10)
    assert "BroadcastExchange" not in plan(graph.components(pairs, ev.select("uid")))
    day, edges, k = 86_400_000_000, set(), 0
    near = lambda a, b, r, t: max(abs(a[1] - b[1]), abs(a[2] - b[2])) <= r and abs((a[3] - b[3]) // day) < t
    while k < 3 or {r[0] for r in rows} - {u for e in edges for u in e}:
        seen = {u for e in edges for u in e}
        edges |= {(min(a[0], b[0]), max(a[0], b[0])) for a in rows for b in rows if a[0] not in seen and (a[0] < b[0] if not k else a[0] != b[0]) and near(a, b, 8.0 * 2**k, 10 * 2**k)}
        k += 1
    got = [(r.src, r.dst) for r in pairs.collect()]
    assert k > 3 and len(got) == len(edges) and set(got) == edges


def test_islands_read_their_tables_once(spark):
    rows = [(k, "a", 100.0 * k, 0.0, 100.0 * k, 0.0, 2000 + k // 10) for k in range(30)]
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(x):
        read.add(1)
        return x

    t = spark.createDataFrame(rows, "uid long, class string, minx double, miny double, maxx double, maxy double, year int").withColumn("minx", seen("minx"))
    j = attribution.ReferenceJoin({"hm": t}, t.withColumnRenamed("uid", "index_reference"))
    assert {(r.uid, r.component) for r in j.get_islands(150.0, 400).collect()} == {(k, 0) for k in range(30)}
    assert read.value == len(rows)


def test_temporal_grid_starts_on_sunday(spark):
    us = lambda t: int(datetime.fromisoformat(t + "+00:00").timestamp() * 1e6)
    m = spark.createDataFrame([(1, us("2022-01-01 05:00:00"), us("2022-01-01 05:00:00"))], "g int, start_us long, end_us long")
    t = sorted(r.t_us for r in extent.temporal_grid(m, "g").collect())
    first = datetime(1970, 1, 1) + timedelta(microseconds=t[0])
    assert first == datetime(2020, 1, 5, 5) and t[1] - t[0] == 14 * 86_400_000_000


def test_footprint(spark):
    rows = [(1, float(x), float(y), "hm", "Fire") for x, y in ((0, 0), (500, 0), (0, 500), (500, 500))]
    df = spark.createDataFrame(rows, "g int, cx double, cy double, dataset string, class string").selectExpr("*", "cx minx", "cy miny", "cx maxx", "cy maxy")
    c = extent.footprint_cells(df, "g").first()
    assert c.cells >= 90
    from boskage.functions.geometry import area, read_wkb

    (r,) = extent.footprints(df, "g").collect()
    kind, parts = read_wkb(r.geometry)
    assert parts and 0 < area(parts) < 1000 * 1000


def test_numbering_and_samples(spark):
    df = spark.range(1000).selectExpr("id * 7 % 1000 k", "id % 5 g")
    assert sorted((r.k, r.uid) for r in relational.numbered(df, ["k"]).collect()) == [(k, k) for k in range(1000)]
    assert relational.numbered(df.limit(0), ["k"]).count() == 0
    s = relational.hash_sample(df, ["g"], "k", 7)
    assert s.groupBy("g").count().where("count != 7").count() == 0 and sorted(map(tuple, s.collect())) == sorted(map(tuple, relational.hash_sample(df.repartition(9), ["g"], "k", 7).collect()))
    c = spark.range(4000).selectExpr("id uid", "concat('r', id % 4) region", "concat('c', id % 7) `class`", "id % 300 community")
    drawn = sampling.stratified(c).collect()
    per = {}
    for r in drawn:
        per.setdefault((r.region, r["class"], r["round"]), []).append(r.community)
    assert all(len(v) <= 10 for v in per.values()) and len({r.uid for r in drawn}) == len(drawn)
    for region in ("r0", "r1"):
        first = [r.community for r in drawn if r.region == region and r["round"] == 1]
        assert len(first) == len(set(first))
    boxes = sampling.place_boxes(spark.createDataFrame([(1, "a", 0.0, 0.0), (2, "a", 100.0, 0.0), (3, "b", 9000.0, 0.0)], "uid long, class string, cx double, cy double")).collect()
    assert [b.uid for b in boxes] == [3, 1]
    own = "uid long, class string, cx double, cy double, minx double, miny double, maxx double, maxy double, kx double, ky double, kminx double, kminy double, kmaxx double, kmaxy double"
    wide = (7000.0, 0.0, -5000.0, -5000.0, 19000.0, 5000.0)  # a community of more than the square
    rows = [(1, "a", 0.0, 0.0, -5000.0, -5000.0, 5000.0, 5000.0, *wide), (2, "b", 16000.0, 0.0, 11000.0, 0.0, 16100.0, 1.0, *wide), (3, "b", 30000.0, 0.0, 29000.0, 0.0, 31000.0, 1.0, *wide)]
    got = [(b.uid, b.minx) for b in sampling.place_boxes(spark.createDataFrame(rows, own)).collect()]
    # the box of 1 is its square, so the square lies around its community; 2 meets it, 3 doesn't
    assert got == [(1, 2000.0), (3, 25000.0)]


@pytest.fixture(scope="module")
def tables(spark):
    e = events(spark, SF)
    cols = ["uid", "class", "year", "cx", "cy", "minx", "miny", "maxx", "maxy"]
    return {"hm": e.where("dataset = 'hm'").select(*cols), "senfseidl": e.where("dataset = 'senfseidl'").select(*cols)}


def test_attribution_invariants(spark, tables):
    a = attribution.Attribution(tables)
    n = sum(t.count() for t in tables.values())
    assert a.detect_communities().count() == n == a.run_hdbscan().count()
    e = a.build_graph()
    assert e.where("src >= dst or weight <= 0").count() == 0
    for mixed in (False, True):
        p = a.attribute(mixed)
        assert p.groupBy("uid").agg(F.abs(F.sum("p") - 1).alias("d")).where("d > 1e-9").count() == 0
    assert a.attribute().select("uid").distinct().count() == tables["senfseidl"].count()
    assert attribution.Attribution(tables, reliability={"hm": 0.1}).events.where("r = 0.1").count() == tables["hm"].count()


def test_reference_join(spark, tables):
    ref = tables["senfseidl"].withColumnRenamed("uid", "index_reference")
    year = ref.groupBy("year").count().orderBy(F.desc("count")).first()["year"]
    j = attribution.ReferenceJoin({"hm": tables["hm"], "cdi": tables["hm"]}, ref, buffers={"hm": 50_000})
    on = j.get_temporal_spatial_join(year)
    assert on.where("dataset = 'hm' and sd > 50000").count() == 0
    assert j.linear_votes(year).where("p < 0 or p > 1").count() == 0
    assert j.get_clusters(year).where("label < -1").count() == 0
    assert j.get_islands(5000.0, 400).count() == tables["hm"].select("uid").distinct().count()
    with pytest.raises(ValueError):
        attribution.validate(tables["hm"].drop("class"), "hm")
    with pytest.raises(ValueError):
        attribution.validate(tables["hm"].drop("minx"), "hm")
    assert attribution.is_entity(events(spark, SF)).count() == 3


def test_stream(spark, tmp_path):
    schema = "uid long, ts timestamp_ntz, minx double, miny double, maxx double, maxy double"
    rows = [(k, datetime(2024, 1, 1 + k // 2), float(k), 0.0, float(k), 0.0) for k in range(6)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    ref = spark.createDataFrame([(7, 0.0, 0.0, 2.0, 2.0)], "index_reference long, minx double, miny double, maxx double, maxy double")
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withColumn("ts", F.col("ts").cast("timestamp"))
    for name, df, mode in (("anchored", anchor(stream, ref, 1.0), "append"), ("counted", anchored_counts(stream, ref, 1.0), "complete")):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert sorted(r.uid for r in spark.table("anchored").collect()) == [0, 1, 2, 3]
    assert spark.table("counted").agg(F.sum("n")).first()[0] == 4


def test_overlay_parts_add_up(spark):
    from boskage.plans.experiment_queries import queries

    parts = queries()["overlay_j15"](spark, SF).groupBy("index_reference").agg(F.sum("overlap").alias("s"))
    ref = spark.read.parquet(f"{SF}/reference_polygons.parquet")
    assert parts.join(ref, "index_reference").where("abs(s - area) > 0.1").count() == 0 and parts.count() == ref.where("area > 0").count()


def test_noise_is_keyed(spark):
    from boskage.operators import experiments

    df = spark.range(5000).selectExpr("id uid")
    a = sorted(r.v for r in df.select(experiments.normal(F.col("uid"), 3).alias("v")).collect())
    b = sorted(r.v for r in df.repartition(7).select(experiments.normal(F.col("uid"), 3).alias("v")).collect())
    assert a == b and abs(np.mean(a)) < 0.06 and abs(np.std(a) - 1) < 0.05


def test_hulls(spark):
    from boskage.functions.geometry import area, read_wkb, write_wkb

    square = lambda x: write_wkb([[np.array([[x, 0], [x + 1, 0], [x + 1, 1], [x, 1]], float)]])
    rows = [(k % 2 if k % 5 else None, square(float(k))) for k in range(40)] + [(7, None)]
    df = spark.createDataFrame(rows, "g int, geometry binary").repartition(5)
    got = {r.g: r.hull for r in extent.hulls(df, ["g"]).collect()}
    assert {g: round(area(read_wkb(h)[1]), 6) for g, h in got.items()} == {0: 37.0, 1: 39.0, None: 36.0, 7: 0}


def test_second_round_shares_by_all_that_is_left(spark):
    # c lacks ten: r0 has 200 communities of two clusters, r1 has 150 of one, r2 none
    c = spark.range(560).selectExpr("id uid", "case when id < 400 then 'r0' when id < 550 then 'r1' else 'r2' end region", "case when id < 550 then 'c' else 'k' end `class`", "case when id < 400 then id div 2 else id end community")
    drawn = sampling.stratified(c).where("class = 'c' and round = 2").groupBy("region").count().collect()
    assert {r.region: r["count"] for r in drawn} == {"r0": 7, "r1": 3}


def test_entities_and_date_gaps(spark):
    from boskage.functions.geometry import write_wkb
    from boskage.plans.analysis_queries import date_gap, spatial_gaps

    square = lambda x: write_wkb([[np.array([[x, 0], [x + 2, 0], [x + 2, 2], [x, 2]], float)]])
    sides = {"p": ("pt", 3.0, 4.0, 3.0, 4.0, 3.0, 4.0, 0.0), "q": ("pt", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)}
    sides |= {k: ("ent", x + 1, 1.0, x, 0.0, x + 2, 2.0, 4.0) for k, x in (("a", 0.0), ("b", 1.0), ("c", 9.0))}
    names = ["uid", "dataset", "cx", "cy", "minx", "miny", "maxx", "maxy", "area"]
    pairs = [("p", "q"), ("p", "a"), ("a", "q"), ("a", "b"), ("a", "c")]
    df = spark.createDataFrame([(i, *sides[i], j, *sides[j]) for i, j in pairs], [f"{s}_{n}" for s in "lr" for n in names])
    kinds = spark.createDataFrame([("pt", False), ("ent", True)], "dataset string, is_entity boolean")
    shapes = spark.createDataFrame([("a", square(0.0)), ("b", square(1.0)), ("c", square(9.0))], "uid string, geometry binary")
    got = {(r.l_uid, r.r_uid): r.x for r in spatial_gaps(df, kinds, shapes).collect()}
    r = (4 / np.pi) ** 0.5
    want = {("p", "q"): 5.0, ("p", "a"): r, ("a", "q"): r, ("a", "b"): r * 3, ("a", "c"): r}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    day = 86_400_000_000
    gap = spark.range(1).select(date_gap(F.lit(5), F.lit(3 * day), F.lit(2 * day - 1), F.lit(13 * day)).alias("g")).first().g
    assert gap == 5.5


def test_any_pair_of_species_may_agree(spark):
    from boskage.plans.analysis_queries import species_agree

    rows = [("Oak, Norway Spruce", "Beech,norway spruce"), ("Oak", "Beech"), ("Oak", "Beech,Oak"), (None, "Oak"), ("Oak", None), ("Beech", "Beech")]
    df = spark.createDataFrame(rows, "ei string, ej string")
    texts = df.selectExpr("explode(array(ei, ej)) essence")
    got = {(r.ei, r.ej): r.agree for r in species_agree(df, texts).collect()}
    assert [got[r] for r in rows] == [True, False, True, False, False, True]
