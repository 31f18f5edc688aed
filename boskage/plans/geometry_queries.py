"""Queries of unions, overlays, masks, outlines, regions, the yearly join and what is drawn from cluster tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from boskage.config import ACCURACY, BUFFER_M, COMPATIBLE, TEMPORAL_BUFFER_YEARS
from boskage.functions import geometry, profiles
from boskage.operators import cluster, extent, graph, overlay, raster, spatial_join
from boskage.operators.proximity import located, near_locations
from boskage.plans import attribution, preprocess
from boskage.plans.analysis_queries import _AFFINE, _COMPONENTS, _EDGES, _PAIRS, BOX, SHAPE, _near, _near_sql, date_gap
from boskage.plans.carriers import EVENTS_SQL, PIXELS_SQL, events, gaps_sql, pixels
from boskage.plans.experiment_queries import _BY, CELLS_SQL, PERIOD_SQL, profile_sql
from boskage.plans.preparation import RADIUS_M, dataset_key
from boskage.plans.registry import Registry
from boskage.session import stable, table

R = Registry()


def _squares(s, d):
    e = events(s, d).where("dataset = 'senfseidl'")
    return extent.squares(e.select("uid", "class", "cx", "cy")).withColumn("geometry", geometry.box_wkb("minx", "miny", F.lit(10_000.0)))


_SQUARES = "sq as (select uid, class, cx - 5000 minx, cy - 5000 miny, cx + 5000 maxx, cy + 5000 maxy from ev where dataset = 'senfseidl')"


@R.query(
    "dissolve_area_a17",
    f"with {EVENTS_SQL}, {_SQUARES}, xs as (select class, x, lead(x) over (partition by class order by x) x2 from (select class, minx x from sq union select class, maxx from sq)), "
    "strips as (select xs.class, x, x2, miny, maxy from xs join sq on sq.class = xs.class and minx <= x and maxx >= x2), "
    "m as (select *, max(maxy) over (partition by class, x order by miny, maxy rows between unbounded preceding and 1 preceding) before from strips) "
    "select class, round(sum((x2 - x)*greatest(0, maxy - greatest(miny, coalesce(before, miny)))), -1) area from m group by 1",
)
def _(s, d):
    return overlay.dissolved_areas(_squares(s, d), ["class"]).select("class", F.round("area", -1).alias("area"))


@R.query("dissolve_class_year_g9", "select class, year, true area_agrees from reference_polygons group by 1, 2")
def _(s, d):
    # the reference polygons don't overlap, so their union has the sum of their areas
    ref = table(s, d, "reference_polygons")
    own = ref.groupBy("class", "year").agg(F.sum("area").alias("whole"))
    made = overlay.dissolved_areas(ref, ["class", "year"]).select(F.col("class").alias("c"), F.col("year").alias("y"), "area")
    on = own.join(made, F.col("class").eqNullSafe(F.col("c")) & F.col("year").eqNullSafe(F.col("y")), "left")
    return on.select("class", "year", (F.abs(F.col("area") - F.col("whole")) < 0.01 + 1e-5 * F.col("whole")).alias("area_agrees"))


@R.query("overlay_squares_j15", f"with {EVENTS_SQL}, {_SQUARES} select a.uid a, b.uid b, round((least(a.maxx, b.maxx) - greatest(a.minx, b.minx))*(least(a.maxy, b.maxy) - greatest(a.miny, b.miny)), 1) area from sq a join sq b on a.uid < b.uid and a.minx < b.maxx and b.minx < a.maxx and a.miny < b.maxy and b.miny < a.maxy")
def _(s, d):
    sq = _squares(s, d).select("uid", "geometry", *BOX)
    on = overlay.overlaid(sq, sq, 10_000.0).where("l_uid < r_uid")
    return on.select(F.col("l_uid").alias("a"), F.col("r_uid").alias("b"), F.round(geometry.measure("geometry")["area"], 1).alias("area"))


@R.query("mask_j16", f"with {EVENTS_SQL}, {_SQUARES} select r.index_reference, true inside from reference_polygons r join (select distinct uid from sq where class = 'Fire') q on q.uid = r.index_reference")
def _(s, d):
    # the squares of fires as mask: every fire's polygon lies in its own
    mask = _squares(s, d).where("class = 'Fire'")
    ref = table(s, d, "reference_polygons").where("class = 'Fire' and year is not null")
    cut = overlay.masked(ref, mask, "index_reference", 10_000.0).select("index_reference", geometry.measure("geometry")["area"].alias("part"))
    most = cut.groupBy("index_reference").agg(F.max("part").alias("part"))
    return ref.join(most, "index_reference").select("index_reference", (F.abs(F.col("part") - F.col("area")) < 0.1).alias("inside"))


@R.query("merge_j17", f"with {EVENTS_SQL}, {_near_sql('p', 1000.0)} select uid from ev where dataset = 'senfseidl' union all select uid from ev where dataset = 'hm' and uid not in (select src from p)")
def _(s, d):
    e = events(s, d).select("uid", "dataset", *SHAPE)
    return overlay.merged(e.where("dataset = 'senfseidl'"), e.where("dataset = 'hm'"), "uid", 1000.0).select("uid")


@R.query("region_outlines_r1", f"with recursive {PIXELS_SQL}, p as (select row, col, value v, row::bigint*64 + col uid from pixels), e as (select a.uid src, b.uid dst from p a join p b on a.v = b.v and ((b.row = a.row and b.col = a.col + 1) or (b.row = a.row + 1 and b.col = a.col))), {_COMPONENTS.format(e='e')}, l as (select p.*, coalesce(c, uid) g from p left join grown on u = uid) select g region, v as value, count(*)*900 area, (600000 + 30*min(col))::bigint minx, (6700000 - 30*min(row))::bigint maxy from l group by 1, 2")
def _(s, d):
    drawn = raster.region_outlines(raster.regions(pixels(s, d).select("row", "col", "value"), 64), _AFFINE)
    m = drawn.select("region", "value", geometry.measure("geometry").alias("m"))
    return m.select("region", "value", F.round("m.area").cast("long").alias("area"), F.round("m.minx").cast("long").alias("minx"), F.round("m.maxy").cast("long").alias("maxy"))


@R.query("spatial_sim_k16", f"with {EVENTS_SQL}, {_PAIRS},{gaps_sql('p', 'pg')}, x as (select src, dst, gap::double x from pg) select x.src i, x.dst j, round(({profile_sql('x', 'a.dataset', 'a.class', 'spatial')} + {profile_sql('x', 'b.dataset', 'b.class', 'spatial')})/2, 6) spatial from x join ev a on a.uid = x.src join ev b on b.uid = x.dst")
def _(s, d):
    e = events(s, d).select("uid", "cx", "cy", *SHAPE, "mid_us", "dataset", "class")
    on = spatial_join.candidate_pairs(e, 6000.0, 720).withColumn("x", spatial_join.gaps())
    w = profiles.pair_weight(F.col("x"), F.col("l_dataset"), F.col("l_class"), F.col("r_dataset"), F.col("r_class"), "spatial")
    return on.select(F.col("l_uid").alias("i"), F.col("r_uid").alias("j"), F.round(w, 6).alias("spatial"))


_DAYS = "(abs(a.start_us // 86400000000 - b.start_us // 86400000000) + abs(a.end_us // 86400000000 - b.end_us // 86400000000))/2"


@R.query("temporal_sim_k17", f"with {EVENTS_SQL}, {_PAIRS}, x as (select p.src, p.dst, {_DAYS} x, a.dataset da, a.class ca, b.dataset db, b.class cb from p join ev a on a.uid = p.src join ev b on b.uid = p.dst) select src i, dst j, round(({profile_sql('x', 'da', 'ca', 'temporal')} + {profile_sql('x', 'db', 'cb', 'temporal')})/2, 6) temporal from x")
def _(s, d):
    on = _near(s, d).withColumn("gap", date_gap(*(F.col(c) for c in ("l_start_us", "l_end_us", "r_start_us", "r_end_us"))))
    w = profiles.pair_weight(F.col("gap"), F.col("l_dataset"), F.col("l_class"), F.col("r_dataset"), F.col("r_class"), "temporal")
    return on.select(F.col("l_uid").alias("i"), F.col("r_uid").alias("j"), F.round(w, 6).alias("temporal"))


_YEAR = 2012
_YEARLY = f"""with {EVENTS_SQL}, near as (select * from ev where (dataset = 'firepolygons' or dataset = 'hm') and year(make_timestamp(start_us)) >= {_YEAR - TEMPORAL_BUFFER_YEARS} and year(make_timestamp(end_us)) <= {_YEAR + TEMPORAL_BUFFER_YEARS}),
ref as (select index_reference uid, minx, miny, maxx, maxy from reference_polygons where year = {_YEAR}),
c as (select a.uid src, b.uid dst from near a join ref b on a.minx - {BUFFER_M['hm']} <= b.maxx and b.minx <= a.maxx + {BUFFER_M['hm']} and a.miny - {BUFFER_M['hm']} <= b.maxy and b.miny <= a.maxy + {BUFFER_M['hm']}),
{gaps_sql('c', 'g')}, t as (select src, dst, gap, dataset, class, min(gap) over (partition by src) least_gap from g join near n on n.uid = g.src where gap <= case when dataset = 'hm' then {BUFFER_M['hm']} else 0 end),
y as (select src uid, dst index_reference, dataset, class, gap sd from t where dataset <> 'hm' or gap = least_gap)"""


def _yearly(s, d):
    e = events(s, d)
    at = lambda c: F.expr(f"timestampadd(MICROSECOND, {c}_us, timestamp_ntz'1970-01-01')").alias(f"{c}_date")
    tables = {n: e.where(F.col("dataset") == n).select("uid", "class", *SHAPE, at("start"), at("end")) for n in ("hm", "firepolygons")}
    return attribution.ReferenceJoin(tables, table(s, d, "reference_polygons"))


@R.query("yearly_join", _YEARLY + " select uid, index_reference, dataset, class, round(sd, 4) sd from y")
def _(s, d):
    return _yearly(s, d).get_temporal_spatial_join(_YEAR).withColumn("sd", F.round("sd", 4))


_COMPAT_SQL = "(values " + ", ".join(f"('{f}', '{c}')" for f, cs in COMPATIBLE.items() for c in cs) + ") k(final, cls)"


@R.query(
    "yearly_linear_votes",
    _YEARLY + f""", v as (select index_reference, class, greatest(0, least(1, case when sd/1000 <= 1 then 1.0 else 1 - (sd/1000 - 1)/9 end)) * case dataset when 'hm' then {ACCURACY['hm']} else {ACCURACY['firepolygons']} end p from y),
whole as (select index_reference, sum(p) al, count(*) n, avg(p) mean, min(case when class = 'Other' then 1 else 0 end) oo from v group by 1),
per as (select index_reference, final, sum(p) own from v join {_COMPAT_SQL} on class = cls group by 1, 2)
select index_reference, final, round(own/al, 6) p, n from per join whole using (index_reference) where oo = 0 and al > 0 union all select index_reference, 'Other', round(mean, 6), n from whole where oo = 1""",
)
def _(s, d):
    return _yearly(s, d).linear_votes(_YEAR).withColumn("p", F.round("p", 6))


@R.query("yearly_clusters")
def _(s, d):
    return _yearly(s, d).get_clusters(_YEAR)


@R.query("islands")
def _(s, d):
    return _yearly(s, d).get_islands(3000.0, 400)


@R.query("p4_regions")
def _(s, d):
    rows = table(s, d, "group_sample").select("row_id", "geometry", dataset_key().alias("side")).where("side = 'hm'")
    places = stable(located(rows, "row_id", "geometry", "side"))
    # places that several rows share are looked up once
    spots = places.select("x", "y").distinct()
    regions = table(s, d, "reference_polygons").select("index_reference", "geometry", *BOX)
    held = spatial_join.containing(spots, regions, 1000.0).select(F.col("l_x").alias("x"), F.col("l_y").alias("y"), F.col("r_index_reference").alias("index_reference"))
    return places.join(held, ["x", "y"]).select(F.col("row").alias("row_id"), "index_reference")


_GREAT = "2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(a.latitude - b.latitude)/2), 2) + cos(radians(a.latitude))*cos(radians(b.latitude))*pow(sin(radians(a.longitude - b.longitude)/2), 2))))"


@R.query("p4_great_circle", f"with q as (select longitude, latitude, count(distinct record_id) n from hm_reports where longitude is not null and latitude is not null group by 1, 2) select a.longitude lon_a, a.latitude lat_a, b.longitude lon_b, b.latitude lat_b, a.n n_a, b.n n_b from q a join q b on (a.longitude, a.latitude) < (b.longitude, b.latitude) where {_GREAT} <= {20 * RADIUS_M}")
def _(s, d):
    # places of reports instead of reports: those of one place are counted
    placed = table(s, d, "hm_reports").where("longitude is not null and latitude is not null")
    q = stable(placed.groupBy(F.col("longitude").alias("x"), F.col("latitude").alias("y")).agg(F.count_distinct("record_id").alias("n")))
    pairs = near_locations(q, q, 20 * RADIUS_M, "great_circle").where("struct(ax, ay) < struct(bx, by)")
    side = lambda p: q.select(F.col("x").alias(f"{p}x"), F.col("y").alias(f"{p}y"), F.col("n").alias(f"n_{p}"))
    on = pairs.join(side("a"), ["ax", "ay"]).join(side("b"), ["bx", "by"])
    return on.select(F.col("ax").alias("lon_a"), F.col("ay").alias("lat_a"), F.col("bx").alias("lon_b"), F.col("by").alias("lat_b"), "n_a", "n_b")


@R.query("reliable_p12", f"select * from ({PERIOD_SQL}) where threshold > 0.7")
def _(s, d):
    e = events(s, d).where("class != 'unknown'").withColumn("g", F.concat_ws("/", "class", "year"))
    return extent.temporal_period(e, "g").withColumn("threshold", F.round("threshold", 6)).where("threshold > 0.7")


_TIED = f"{_EDGES}, {_COMPONENTS.format(e='e')}, ev2 as (select ev.*, c g from ev join grown on u = uid where class <> 'unknown')"
_OF_TIED = [sql.replace("with ", "with recursive ", 1).replace(_BY, _TIED) for sql in (PERIOD_SQL, CELLS_SQL)]


@R.query(
    "cluster_periods_c8",
    f"with recursive {EVENTS_SQL}, {_TIED}, n as (select g, count(*) members, count(distinct dataset) sources from ev2 group by 1) select g, members, sources, left_us, right_us, a.threshold temporal_threshold, b.threshold spatial_threshold from n join ({_OF_TIED[0]}) a using (g) join ({_OF_TIED[1]}) b using (g)",
)
def _(s, d):
    e = stable(events(s, d).where("uid is not null"))
    found = graph.components(attribution.weighted_edges(e)).select("uid", F.col("component").alias("g"))
    members = stable(e.where("class != 'unknown'").join(found, "uid"))
    period = extent.temporal_period(members, "g").withColumn("temporal_threshold", F.round("threshold", 6)).drop("threshold")
    cells = extent.footprint_cells(members, "g").select("g", F.round("threshold", 6).alias("spatial_threshold"))
    n = members.groupBy("g").agg(F.count("*").alias("members"), F.count_distinct("dataset").alias("sources"))
    return n.join(period, "g").join(cells, "g")


@R.query("noise_share_v6", f"with recursive st as (select src, dst from edges where 1 - ws <= 0.5), {_COMPONENTS.format(e='st')}, v as (select src u from edges union select dst from edges), l as (select v.u, coalesce(c, -1) label from v left join grown using (u)) select g.class, count(*) n, sum(case when label = -1 then 1 else 0 end)::bigint noise, round(avg(case when label = -1 then 1.0 else 0.0 end), 6) noise_share from l join group_sample g on g.row_id = l.u group by 1")
def _(s, d):
    e = table(s, d, "edges")
    members = e.select(F.explode(F.array("src", "dst")).alias("uid"))
    labels = cluster.dbscan_pairs(e.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("ws").alias("s")), members, 0.5)
    on = labels.join(table(s, d, "group_sample").select(F.col("row_id").alias("uid"), "class"), "uid").withColumn("lost", (F.col("label") == -1).cast("long"))
    return on.groupBy("class").agg(F.count("*").alias("n"), F.sum("lost").alias("noise"), F.round(F.avg("lost"), 6).alias("noise_share"))


@R.query("centroids_e4", f"with {EVENTS_SQL}, k as (select dataset, quantile_cont(area/1e6, 0.95) >= pi()*0.01 ent from ev group by 1), m as (select class, year, cx, cy, ent, min(case when ent then 1 else 0 end) over (partition by class, year) only_ent from ev join k using (dataset)) select class, year, count(*) points, string_agg(c, ', ' order by c) places from (select distinct class, year, round(cx*100)::bigint || ' ' || round(cy*100)::bigint c from m where not ent or only_ent = 1) group by 1, 2")
def _(s, d):
    e = events(s, d)
    own = e.join(F.broadcast(attribution.is_entity(e)), "dataset")
    kept = extent.without_large(own.withColumn("g", F.struct("class", "year")), "g")
    at = F.concat_ws(" ", F.round(F.col("cx") * 100).cast("long"), F.round(F.col("cy") * 100).cast("long"))
    points = kept.groupBy("class", "year").agg(F.sort_array(F.collect_set(at)).alias("c"))
    return points.select("class", "year", F.size("c").cast("long").alias("points"), F.array_join("c", ", ").alias("places"))


@R.query("community_heuristics_m12", f"with {EVENTS_SQL}, g as (select class, year, count(*) n, sqrt(pow(max(maxx) - min(minx), 2) + pow(max(maxy) - min(miny), 2)) dia from ev group by 1, 2) select round(median(dia), 3) median_diameter, quantile_cont(n, 0.9)::double p90_size from g")
def _(s, d):
    span = lambda c: F.pow(F.max(f"max{c}") - F.min(f"min{c}"), F.lit(2))
    g = events(s, d).groupBy("class", "year").agg(F.count("*").alias("n"), F.sqrt(span("x") + span("y")).alias("dia"))
    return g.agg(F.round(F.median("dia"), 3).alias("median_diameter"), F.percentile("n", 0.9).cast("double").alias("p90_size"))


_PLOTS = "select p_partkey k, p_partkey % 6 ninc, case when p_partkey % 5 < 4 then (p_partkey % 5)::varchar end dc, case when p_partkey % 7 < 4 then (p_partkey % 7)::varchar end prelev5, 2006 + p_size % 15 y, case when p_partkey % 3 > 0 then p_partkey % 3 end dead from part"


@R.query(
    "inventory_dates_d11",
    f"with p as ({_PLOTS}) select k, case when ninc = 1 then 'Fire' when ninc = 2 then 'Mortality' when ninc in (3, 4) then 'Storm' when ninc = 0 and (dc in ('1','2','3','4','5','6','7','8','9') or prelev5 = '2') then 'Anthropogenic' else 'Other' end as class, case when dead = 1 then make_date(y - 5, 1, 1) end start_date, case when dead = 2 then make_date(y - 5, 12, 28) else make_date(y, 12, 28) end end_date from p",
)
def _(s, d):
    k = F.col("p_partkey").cast("long")
    text = lambda m: F.when(k % m < 4, (k % m).cast("string"))
    plots = table(s, d, "part").select(
        k.alias("k"), (k % 6).cast("int").alias("NINCID"), F.lit(None).cast("string").alias("INCID"), text(5).alias("DC"), text(7).alias("PRELEV5"),
        (2006 + F.col("p_size") % 15).cast("int").alias("CAMPAGNE"), F.when(k % 3 > 0, (k % 3).cast("int")).alias("DATEMORT"),
    )
    return preprocess.classify_inventory_by_incident(plots).select("k", "class", "start_date", "end_date")


@R.query("interval_pairs_j13", f"with {EVENTS_SQL}, f as (select class, year // 4 y, min(start_us) s, max(end_us) e from ev where dataset = 'firepolygons' or class <> 'Fire' group by 1, 2) select a.class, a.y ya, b.y yb from f a join f b on a.class = b.class and a.y < b.y where not (a.e < b.s or a.s > b.e) union all select a.class || '/' || b.class, a.y, b.y from f a join f b on a.class < b.class and a.y = b.y where not (a.e < b.s or a.s > b.e)")
def _(s, d):
    f = events(s, d).where("dataset = 'firepolygons' or class != 'Fire'").groupBy("class", F.expr("year div 4").alias("y")).agg(F.min("start_us").alias("s"), F.max("end_us").alias("e"))
    a, b = (f.select(*(F.col(c).alias(p + c) for c in f.columns)) for p in ("a_", "b_"))
    meet = "not (a_e < b_s or a_s > b_e)"
    same = a.join(b, (F.col("a_class") == F.col("b_class")) & (F.col("a_y") < F.col("b_y"))).where(meet).select(F.col("a_class").alias("class"), F.col("a_y").alias("ya"), F.col("b_y").alias("yb"))
    other = a.join(b, (F.col("a_y") == F.col("b_y")) & (F.col("a_class") < F.col("b_class"))).where(meet)
    return same.unionByName(other.select(F.concat_ws("/", "a_class", "b_class").alias("class"), F.col("a_y").alias("ya"), F.col("b_y").alias("yb")))


def queries() -> dict:
    return dict(R.found)


def oracle_sql() -> dict[str, str]:
    return dict(R.sql)
