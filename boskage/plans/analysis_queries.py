"""Queries of the spatial, graph, clustering, extent, raster and quality operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from boskage.config import SIMILARITY_WEIGHTS
from boskage.functions import fuzzy, geometry, planar, profiles
from boskage.operators import cluster, extent, graph, metrics, raster, sampling, spatial_join, votes
from boskage.plans import attribution
from boskage.plans.carriers import EVENTS_SQL, PIXELS_SQL, X_SQL, Y_SQL, events, gaps_sql, pixels
from boskage.plans.registry import Registry
from boskage.session import table

R = Registry()
GAP = "greatest(0, a.minx - b.maxx, b.minx - a.maxx)", "greatest(0, a.miny - b.maxy, b.miny - a.maxy)"
DIST = f"sqrt(({GAP[0]})*({GAP[0]}) + ({GAP[1]})*({GAP[1]}))"
MEET = "a.minx <= b.maxx and b.minx <= a.maxx and a.miny <= b.maxy and b.miny <= a.maxy"
BOX = spatial_join.BOX
SHAPE = (*BOX, "geometry")


def _kinds(s, d):
    e = events(s, d)
    return e.where("dataset = 'hm'"), e.where("dataset = 'senfseidl'")


def _near_sql(name: str, radius: float) -> str:
    """(src, dst, gap) of reports and reference polygons at most that far apart."""
    boxes = f"{name}_boxes as (select a.uid src, b.uid dst from ev a join ev b on a.dataset = 'hm' and b.dataset = 'senfseidl' and {DIST} <= {radius})"
    return f"{boxes},{gaps_sql(f'{name}_boxes', f'{name}_gaps')}, {name} as (select * from {name}_gaps where gap <= {radius})"


@R.query("spatial_intersects_j5", f"with {EVENTS_SQL}, {_near_sql('p', 0.0)} select src a, dst b from p")
def _(s, d):
    h, r = _kinds(s, d)
    pairs = spatial_join.within_distance(h.select("uid", *SHAPE), r.select("uid", *SHAPE), 0.0)
    return pairs.select(F.col("l_uid").alias("a"), F.col("r_uid").alias("b"))


@R.query("buffer_intersects_j5", f"with {EVENTS_SQL}, {_near_sql('p', 5000.0)} select src a, dst b from p")
def _(s, d):
    h, r = _kinds(s, d)
    pairs = spatial_join.within_distance(h.select("uid", *SHAPE), r.select("uid", *SHAPE), 5000.0)
    return pairs.select(F.col("l_uid").alias("a"), F.col("r_uid").alias("b"))


@R.query("nearest_j6", f"with {EVENTS_SQL}, {_near_sql('p', 7000.0)}, t as (select *, min(gap) over (partition by src) m from p) select src a, dst b, round(gap, 6) sd from t where gap = m")
def _(s, d):
    h, r = _kinds(s, d)
    found = spatial_join.nearest(h.select("uid", *SHAPE), r.select("uid", *SHAPE), "uid", 7000.0)
    return found.select(F.col("l_uid").alias("a"), F.col("r_uid").alias("b"), F.round("sd", 6).alias("sd"))


_PAIRS = "p as (select a.uid src, b.uid dst, a.r ra, b.r rb, a.dataset da, b.dataset db, abs(floor((a.mid_us - b.mid_us)/86400000000.0)) dt from ev a join ev b on a.uid < b.uid and b.minx <= a.cx + 6000 and b.maxx >= a.cx - 6000 and b.miny <= a.cy + 6000 and b.maxy >= a.cy - 6000 where abs(floor((a.mid_us - b.mid_us)/86400000000.0)) <= 720)"
_EDGES = f"{_PAIRS},{gaps_sql('p', 'pg')}, e as (select src, dst, exp(-gap/1000.0)*exp(-dt/180.0)*(ra + rb)/2*case when da = db then 0.5 else 1.0 end w from p join pg using (src, dst) where gap <= 6000)"


@R.query("candidate_pairs_j9", f"with {EVENTS_SQL}, {_PAIRS} select src, dst, dt::bigint n_days from p")
def _(s, d):
    pairs = spatial_join.candidate_pairs(events(s, d).select("uid", "cx", "cy", *BOX, "mid_us"), 6000.0, 720)
    return pairs.select(F.col("l_uid").alias("src"), F.col("r_uid").alias("dst"), F.col("days").alias("n_days"))


@R.query("edge_weight_k1", f"with {EVENTS_SQL}, {_EDGES} select src, dst, round(w, 6) w from e where w > 0")
def _(s, d):
    return attribution.weighted_edges(events(s, d)).select("src", "dst", F.round("weight", 6).alias("w"))


@R.query("polygon_distance_g4", f"with {EVENTS_SQL}, q as (select a.uid src, b.uid dst from ev a join ev b on a.dataset = 'senfseidl' and b.dataset = 'senfseidl' and a.uid < b.uid and {DIST} <= 5000),{gaps_sql('q', 'g')} select src, dst, round(gap, 3) gap from g where gap <= 5000")
def _(s, d):
    r = _kinds(s, d)[1].select("uid", *SHAPE)
    pairs = spatial_join.within_distance(r, r, 5000.0).where("l_uid < r_uid")
    return pairs.select(F.col("l_uid").alias("src"), F.col("r_uid").alias("dst"), F.round("sd", 3).alias("gap"))


def _strict(r: float, t: float) -> str:
    return f"a.uid < b.uid and a.minx - {r} <= b.maxx and b.minx <= a.maxx + {r} and a.miny - {r} <= b.maxy and b.miny <= a.maxy + {r} and abs(floor((a.mid_us - b.mid_us)/86400000000.0)) < {t}"


@R.query("strict_pairs_j10", f"with {EVENTS_SQL} select a.uid src, b.uid dst from ev a join ev b on {_strict(3000.0, 400)}")
def _(s, d):
    return spatial_join.strict_pairs(events(s, d).select("uid", *BOX, "mid_us"), 3000.0, 400).select("src", "dst")


def _widened(k: int) -> str:
    cond = _strict(3000.0 * 2**k, 400 * 2**k)
    return f"s{k} as (select src u from e{k - 1} union select dst from e{k - 1}), e{k} as (select src, dst from e{k - 1} union select a.uid, b.uid from ev a join ev b on {cond} where a.uid not in (select u from s{k}) or b.uid not in (select u from s{k}))"


# as many rounds as the radius needs to cover the country; further ones find nothing, since no event is alone by then
@R.query("adaptive_pairs_j11", f"with {EVENTS_SQL}, e0 as (select a.uid src, b.uid dst from ev a join ev b on {_strict(3000.0, 400)}), {', '.join(map(_widened, range(1, 11)))} select distinct src, dst from e10")
def _(s, d):
    return spatial_join.adaptive_pairs(events(s, d).select("uid", *BOX, "mid_us"), 3000.0, 400).select("src", "dst").distinct()


@R.query("entity_attach_j12", f"with {EVENTS_SQL}, g as (select class, year // 3 y, min(minx) minx, min(miny) miny, min(minx) + 20000 maxx, min(miny) + 20000 maxy, min(start_us) start_us, max(end_us) end_us from ev where dataset = 'hm' group by 1, 2) select a.class, a.y, b.uid from g a join ev b on b.dataset = 'senfseidl' and {MEET} and b.mid_us between a.start_us - 31536000000000 and a.end_us + 31536000000000")
def _(s, d):
    h, r = _kinds(s, d)
    g = h.withColumn("y", F.expr("year div 3")).groupBy("class", "y").agg(F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"))
    g = g.withColumns({"maxx": F.col("minx") + 20000, "maxy": F.col("miny") + 20000})
    return spatial_join.attach(g, r.select("uid", *BOX, "mid_us"), 20_000.0, 365).select(F.col("l_class").alias("class"), F.col("l_y").alias("y"), F.col("r_uid").alias("uid"))


@R.query(
    "enrich_species_j14",
    f"with {EVENTS_SQL}, {_near_sql('n', 8000.0)}, m as (select src uid, b.tree_type, b.essence from n join ev b on b.uid = n.dst), g as (select uid, count(*) hits, count(distinct tree_type) + max(case when tree_type is null then 1 else 0 end) kinds, max(tree_type) one, coalesce(string_agg(distinct essence, ',' order by essence), '') essence from m group by 1) select h.uid, coalesce(hits, 0) hits, case when hits is null then null when kinds = 1 then one else 'Mixed' end tree_type, g.essence from ev h left join g using (uid) where h.dataset = 'hm'",
)
def _(s, d):
    h, r = _kinds(s, d)
    return spatial_join.enrich(h.select("uid", *SHAPE), r, "uid", 8000.0)


_REF = "q as (select index_reference uid, round((minx + maxx)/2, 2) cx, round((miny + maxy)/2, 2) cy from reference_polygons), r as (select uid, cx - 5000 minx, cy - 5000 miny, cx + 5000 maxx, cy + 5000 maxy from q)"
_I = "(greatest(0, least(a.maxx, b.maxx) - greatest(a.minx, b.minx)) * greatest(0, least(a.maxy, b.maxy) - greatest(a.miny, b.miny)))"
_AREA = "({0}.maxx - {0}.minx)*({0}.maxy - {0}.miny)"


@R.query("pairwise_overlap_j22", f"with {_REF} select a.uid a, b.uid b, round({_I}, 2) overlap, round({_I}/({_AREA.format('a')} + {_AREA.format('b')} - {_I}), 6) iou from r a join r b on a.uid < b.uid and {MEET}")
def _(s, d):
    mid = lambda c: F.round((F.col(f"min{c}") + F.col(f"max{c}")) / 2, 2).alias(f"c{c}")
    r = extent.squares(table(s, d, "reference_polygons").select(F.col("index_reference").alias("uid"), mid("x"), mid("y"))).select("uid", *BOX)
    pairs = spatial_join.meeting(r, r, 10_000.0).where("l_uid < r_uid")
    a, b = planar.rect("l_"), planar.rect("r_")
    return pairs.select(F.col("l_uid").alias("a"), F.col("r_uid").alias("b"), F.round(planar.rect_overlap(a, b), 2).alias("overlap"), F.round(planar.rect_iou(a, b), 6).alias("iou"))


@R.query("box_features_j21", f"with {EVENTS_SQL}, s as (select uid, cx - 5000 minx, cy - 5000 miny, cx + 5000 maxx, cy + 5000 maxy from ev where class = 'Fire') select a.uid box, b.uid, row_number() over (partition by a.uid order by b.uid) - 1 ordinal from s a join ev b on {MEET}")
def _(s, d):
    e = events(s, d)
    boxes = extent.squares(e.where("class = 'Fire'").select("uid", "cx", "cy")).select("uid", *BOX)
    pairs = spatial_join.meeting(boxes, e.select("uid", *BOX), 10_000.0)
    k = F.row_number().over(Window.partitionBy("l_uid").orderBy("r_uid")) - 1
    return pairs.select(F.col("l_uid").alias("box"), F.col("r_uid").alias("uid"), k.alias("ordinal"))


_AFFINE = (30.0, 0.0, 600000.0, 0.0, -30.0, 6700000.0)


@R.query("pixel_lookup_j18", f"with {PIXELS_SQL}, pts as (select part.p_partkey uid, 600000 + (p_partkey*37 % 2100) x, 6700000 - (p_partkey*53 % 1000) y from part), g as (select uid, floor((x - 600000)/30)::int col, floor((6700000 - y)/30)::int as row from pts) select g.uid, p.value from g left join pixels p on p.row = g.row and p.col = g.col")
def _(s, d):
    p = table(s, d, "part").select(F.col("p_partkey").alias("uid"), (600000 + F.col("p_partkey") * 37 % 2100).cast("double").alias("cx"), (6700000 - F.col("p_partkey") * 53 % 1000).cast("double").alias("cy"))
    return spatial_join.pixel_lookup(p, pixels(s, d), _AFFINE).select("uid", "value")


@R.query("profile_curves_k11", "select x, round((case when x <= 10 then 1.0 else exp(-pow(x - 10, 2)/(2*2500.0)) end + exp(-0.5*pow(x/500.0, 2)))/2, 6) hm_fire, round((case when x <= 30 then 1.0 else exp(-pow(x - 30, 2)/(2*5625.0)) end + 0.87*exp(-0.5*pow(x/500.0, 2)) + 0.1*exp(-0.5*pow(x/2000.0, 2)) + 0.01*exp(-0.5*pow(x/1000.0, 2)) + 0.01*exp(-0.5*pow(x/2500.0, 2)) + 0.01*exp(-0.5*pow(x/500.0, 2)))/2, 6) senfseidl_fire, round((case when x between 0 and 365 then 1.0 else 0.0 end + exp(-0.5*pow(x/1095.0, 2)))/2, 6) hm_fire_days from (select unnest(range(0, 2001, 10))::double x)")
def _(s, d):
    x = F.col("x")
    return s.range(0, 2001, 10).select(F.col("id").cast("double").alias("x")).select(
        "x", F.round(profiles.profile(x, "hm", "Fire", "spatial"), 6).alias("hm_fire"), F.round(profiles.profile(x, "senfseidl", "Fire", "spatial"), 6).alias("senfseidl_fire"),
        F.round(profiles.profile(x, "hm", "Fire", "temporal"), 6).alias("hm_fire_days"),
    )


@R.query("decay_functions_k2_k8", "select x, round(exp(-0.5*pow((x - 50)/20.0, 2)), 6) g, round(1/(1 + exp(-0.1*(x - 40))), 6) sg, round(exp(-0.02*(x - 10)), 6) ed, round(case when x <= 50 then 1.0 else exp(-ln(2.0)*(x - 50)/25) end, 6) wf, round(exp(-ln(2.0)*x/30), 6) hl from (select unnest(range(0, 201))::double x)")
def _(s, d):
    x = F.col("x")
    made = {"g": profiles.gaussian(x, 50, 20), "sg": profiles.sigmoid(x, 40, 0.1), "ed": profiles.exponential_decay(x, 10, 0.02), "wf": profiles.weighting_function(x, 50, 25), "hl": profiles.half_life(x, 30)}
    return s.range(201).select(F.col("id").cast("double").alias("x")).select("x", *(F.round(c, 6).alias(n) for n, c in made.items()))


@R.query("linear_weights_k24", "select index_reference, round(case when km <= 1 then 1.0 else 1 - (km - 1)/9 end, 6) sw, round(case when y <= 3 then 1 - y/12 else 0.75*(1 - (y - 3)/3) end, 6) tw from (select index_reference, sqrt(area/pi())/35 km, abs(year - 2010)::double y from reference_polygons where year is not null)")
def _(s, d):
    r = table(s, d, "reference_polygons").where("year is not null").select("index_reference", (planar.radius_of(F.col("area")) / 35).alias("km"), F.abs(F.col("year") - 2010).cast("double").alias("y"))
    return r.select("index_reference", F.round(profiles.linear_spatial(F.col("km")), 6).alias("sw"), F.round(profiles.linear_temporal(F.col("y")), 6).alias("tw"))


_W = "coalesce(ws,0)", "coalesce(wt,0)", "coalesce(we,0)", "coalesce(wc,0)"


@R.query("edge_modes_k26", f"select src, dst, round(({_W[0]} + {_W[1]})/2, 10) mean2, round(({_W[0]} + {_W[1]} + {_W[2]} + {_W[3]})/4, 10) mean4, round((2*{_W[0]} + 1.5*{_W[1]} + {_W[2]} + 2*{_W[3]})/6.5, 10) eco, round((0.4076*{_W[0]} + 0.2302*{_W[1]} + 0.2057*{_W[2]} + 0.1566*{_W[3]})/(0.4076 + 0.2302 + 0.2057 + 0.1566), 10) pca from edges")
def _(s, d):
    return table(s, d, "edges").select("src", "dst", *(F.round(graph.weight_of(m), 10).alias(m) for m in ("mean2", "mean4", "eco", "pca")))


@R.query("graph_build_c2", "select src, dst, max(w) w, count(*) over () n_edges from (select src, dst, round((coalesce(ws,0) + coalesce(wt,0))/2, 10) w from edges) group by 1, 2")
def _(s, d):
    e = graph.build(table(s, d, "edges").select("src", "dst", F.round(graph.weight_of("mean2"), 10).alias("weight")))
    return e.withColumnRenamed("weight", "w").join(F.broadcast(e.agg(F.count("*").alias("n_edges"))))


def _near(s, d):
    """Pairs of events within 6 km and two years, columns of the sides prefixed."""
    e = events(s, d).select("uid", "cx", "cy", *BOX, "mid_us", "start_us", "end_us", "area", "dataset", "class", "tree_type", "essence")
    return spatial_join.candidate_pairs(e, 6000.0, 720)


def _similar(s, d):
    """The classes and trees of both sides of the pairs."""
    return _near(s, d).select(
        F.col("l_uid").alias("i"), F.col("r_uid").alias("j"), "days",
        F.col("l_dataset").alias("di"), F.col("l_class").alias("ci"), F.col("r_dataset").alias("dj"), F.col("r_class").alias("cj"), F.lower("l_tree_type").alias("ti"), F.lower("r_tree_type").alias("tj"), F.col("l_essence").alias("ei"), F.col("r_essence").alias("ej"),
    )


def _class_table(s):
    return F.broadcast(s.createDataFrame(profiles.class_similarity_rows(), "di string, ci string, dj string, cj string, class double"))


def spatial_gaps(p, kinds, shapes):
    """Pairs with x: the distance of centres; the radius of the entity where one side is; the mean radius over the IoU where both are.

    ``kinds`` is (dataset, is_entity), ``shapes`` (uid, geometry) of the entities; only pairs of
    entities whose boxes overlap can have an IoU and meet their geometries.
    """
    for side in ("l", "r"):
        p = p.join(F.broadcast(kinds.select(F.col("dataset").alias(f"{side}_dataset"), F.col("is_entity").alias(f"{side}_entity"))), f"{side}_dataset", "left")
    l, r = (F.coalesce(F.col(f"{side}_entity"), F.lit(False)) for side in ("l", "r"))
    both = p.where(l & r & (planar.rect_overlap(planar.rect("l_"), planar.rect("r_")) > 0)).select("l_uid", "r_uid").distinct()
    for side in ("l", "r"):
        both = both.join(shapes.select(F.col("uid").alias(f"{side}_uid"), F.col("geometry").alias(f"{side}_g")), f"{side}_uid")
    met = both.select("l_uid", "r_uid", geometry.relate("l_g", "r_g")["overlap"].alias("common"))
    on = p.join(met, ["l_uid", "r_uid"], "left")
    rl, rr = planar.radius_of(F.col("l_area")), planar.radius_of(F.col("r_area"))
    common = F.coalesce("common", F.lit(0.0))
    mean = (rl + rr) / 2
    entities = F.when(common > 0, mean / (common / (F.col("l_area") + F.col("r_area") - common))).otherwise(mean)
    centres = F.sqrt(F.pow(F.col("l_cx") - F.col("r_cx"), 2) + F.pow(F.col("l_cy") - F.col("r_cy"), 2))
    return on.withColumn("x", F.when(l & r, entities).when(l, rl).when(r, rr).otherwise(centres))


def date_gap(start_a, end_a, start_b, end_b):
    """Mean of the gaps of starts and of ends, in days; dates are truncated to the day."""
    day = lambda c: F.floor(c / F.lit(86_400_000_000))
    return (F.abs(day(start_a) - day(start_b)) + F.abs(day(end_a) - day(end_b))) / 2


@R.query("spatial_sim_k15_k17")
def _(s, d):
    kinds = attribution.is_entity(events(s, d))
    shapes = table(s, d, "reference_polygons").select(F.col("index_reference").alias("uid"), "geometry")
    on = spatial_gaps(_near(s, d), kinds, shapes).withColumn("gap", date_gap(*(F.col(c) for c in ("l_start_us", "l_end_us", "r_start_us", "r_end_us"))))
    w = lambda v, kind: F.round(profiles.pair_weight(F.col(v), F.col("l_dataset"), F.col("l_class"), F.col("r_dataset"), F.col("r_class"), kind), 6).alias(kind)
    return on.select(F.col("l_uid").alias("i"), F.col("r_uid").alias("j"), w("x", "spatial"), w("gap", "temporal"))


_CLS = " union all ".join(f"select '{a}' di, '{b}' ci, '{c}' dj, '{e}' cj, {v!r}::double v" for a, b, c, e, v in profiles.class_similarity_rows() if {a, c} <= {"hm", "senfseidl", "firepolygons"})


@R.query("class_sim_k20", f"with {EVENTS_SQL}, {_PAIRS}, c as ({_CLS}) select p.src i, p.dst j, round(coalesce(v, 0), 6) sim from p join ev a on a.uid = p.src join ev b on b.uid = p.dst left join c on c.di = a.dataset and c.ci = a.class and c.dj = b.dataset and c.cj = b.class")
def _(s, d):
    on = _similar(s, d).join(_class_table(s), ["di", "ci", "dj", "cj"], "left")
    return on.select("i", "j", F.round(F.coalesce("class", F.lit(0.0)), 6).alias("sim"))


def species_agree(pairs, texts):
    """Pairs with agree: any species of ``ei`` and any of ``ej`` have a ratio above 80; texts (essence) hold species split by commas."""
    split = lambda c: F.transform(F.split(c, ","), F.trim)
    species = texts.where("essence is not null").distinct().select(F.col("essence").alias("ei"), F.explode(split("essence")).alias("a"))
    near = fuzzy.name_pairs(species, "a").where("ratio > 80").select("a", "b")
    kin = species.join(F.broadcast(near), "a").groupBy("ei").agg(F.collect_set("b").alias("kin"))
    return pairs.join(kin, "ei", "left").withColumn("agree", F.coalesce(F.arrays_overlap("kin", split("ej")), F.lit(False))).drop("kin")


@R.query("tree_coherence_k18")
def _(s, d):
    e = species_agree(_similar(s, d), events(s, d).select("essence"))
    visible = [c for c in ("Fire", "Storm", "Storm,Biotic", "Other")]
    sim = (
        F.when(F.col("ci").isin(*visible) & F.col("cj").isin(*visible), 1.0)
        .when(F.col("agree"), 1.0)
        .when(F.col("ti") == F.col("tj"), 0.75)
        .when((F.col("ti") == "mixed") | (F.col("tj") == "mixed"), 0.5)
        .otherwise(0.25)
    )
    return e.select("i", "j", sim.alias("tree"))


@R.query("combined_sim_k22", "select src i, dst j, round((greatest(0, least(1, coalesce(wt,0)))*2 + greatest(0, least(1, coalesce(ws,0)))*2 + greatest(0, least(1, coalesce(we,0)))*1 + greatest(0, least(1, coalesce(wc,0)))*3)/8, 10) s from edges")
def _(s, d):
    parts = [profiles.clipped(F.col(c)) for c in ("wt", "ws", "we", "wc")]
    return table(s, d, "edges").select(F.col("src").alias("i"), F.col("dst").alias("j"), F.round(profiles.combined(parts, SIMILARITY_WEIGHTS["eco"]), 10).alias("s"))


_COMPONENTS = """
grown(u, c) using key (u) as (
  select u, u from (select src u from {e} union select dst from {e})
  union
  select x.v, min(g.c) from grown g join (select src u, dst v from {e} union all select dst, src from {e}) x on x.u = g.u join recurring.grown r on r.u = x.v where g.c < r.c group by 1
)"""


@R.query("components_c1", f"with recursive st as (select src, dst from edges where ws >= 0.35), {_COMPONENTS.format(e='st')} select u uid, c component from grown")
def _(s, d):
    return graph.components(table(s, d, "edges").where("ws >= 0.35").select("src", "dst"))


@R.query("dbscan_c6", f"with recursive st as (select src, dst from edges where 1 - ws <= 0.5), {_COMPONENTS.format(e='st')}, v as (select src u from edges union select dst from edges) select v.u uid, coalesce(c, -1) as label from v left join grown using (u)")
def _(s, d):
    e = table(s, d, "edges")
    members = e.select(F.explode(F.array("src", "dst")).alias("uid"))
    return cluster.dbscan_pairs(e.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("ws").alias("s")), members, 0.5)


@R.query("louvain_c3")
def _(s, d):
    e = graph.build(table(s, d, "edges").select("src", "dst", graph.weight_of("mean4").alias("weight")))
    return graph.louvain(e, resolution=1.0)


@R.query("modularity_m12", f"with {EVENTS_SQL}, {_EDGES}, m as (select uid, dataset || class c from ev), t as (select sum(w) m from e), j as (select w, a.c ca, b.c cb from e join m a on a.uid = src join m b on b.uid = dst), i as (select ca c, sum(case when ca = cb then w else 0 end) w from j group by 1), d as (select c, sum(w) d from (select ca c, w from j union all select cb, w from j) group by 1) select round(sum(coalesce(i.w, 0)/m - pow(d/(2*m), 2)), 6) modularity from d left join i using (c) cross join t")
def _(s, d):
    e = events(s, d)
    members = e.select("uid", F.concat("dataset", "class").alias("community"))
    return graph.modularity(attribution.weighted_edges(e), members).withColumn("modularity", F.round("modularity", 6))


def _tables(s, d):
    at = lambda c: F.expr(f"timestampadd(MICROSECOND, {c}_us, timestamp_ntz'1970-01-01')").alias(f"{c}_date")
    cols = ["uid", "class", "cx", "cy", *SHAPE, at("start"), at("end")]
    e = events(s, d)
    return {name: e.where(F.col("dataset") == name).select(*cols) for name in ("hm", "senfseidl", "firepolygons")}


@R.query("hdbscan_c4")
def _(s, d):
    return attribution.Attribution(_tables(s, d)).run_hdbscan()


@R.query("attribution_full")
def _(s, d):
    return attribution.Attribution(_tables(s, d)).attribute().withColumn("p", F.round("p", 6))


@R.query(
    "flagship_attribution",
    f"with recursive {EVENTS_SQL}, {_EDGES}, {_COMPONENTS.format(e='e')}, k as (select ev.uid, ev.class, ev.dataset, ev.r, coalesce(g.c, ev.uid) c from ev left join grown g on g.u = ev.uid), cv as (select c, class, sum(r) w from k group by 1, 2), t as (select uid, c, class, r from k where dataset = 'senfseidl'), a as (select uid, class, sum(w) w from (select t.uid, cv.class, w from t join cv using (c) union all select uid, class, r*0.3 from t) group by 1, 2) select uid, class, round(w/sum(w) over (partition by uid), 6) p from a",
)
def _(s, d):
    return attribution.component_attribution(events(s, d)).withColumn("p", F.round("p", 6))


@R.query("vote_map_a11", f"with {EVENTS_SQL}, cv as (select year c, class, sum(r) w from ev group by 1, 2), t as (select uid, year c, class, r from ev where dataset = 'senfseidl'), a as (select uid, class, sum(w) w from (select t.uid, cv.class, w from t join cv using (c) union all select uid, class, r*0.3 from t) group by 1, 2) select uid, class, round(w/sum(w) over (partition by uid), 6) p from a")
def _(s, d):
    e = events(s, d).withColumn("cluster", F.col("year"))
    return votes.cluster_votes(e, e.where("dataset = 'senfseidl'")).withColumn("p", F.round("p", 6))


_COMP = " union all ".join(f"select '{a}' dataset, '{b}' as class, '{c}' final, {v!r}::double share" for a, b, c, v in profiles.composition_rows())


@R.query("predominant_class_a12", f"with {EVENTS_SQL}, comp as ({_COMP}), x as (select ev.year g, final, share, uid from ev join comp on comp.dataset = ev.dataset and comp.class = ev.class), n as (select g, final, count(*) n, round(avg(share), 9) w, min(uid) f from x group by 1, 2), t as (select *, row_number() over (partition by g order by n desc, w desc, f, final) k from n) select g, final, n, round(w, 6) w from t where k = 1")
def _(s, d):
    comp = s.createDataFrame([(a, b, c, v) for a, b, c, v in profiles.composition_rows()], "dataset string, class string, final string, share double")
    x = votes.composition_entries(events(s, d).select(F.col("year").alias("g"), "dataset", "class", F.col("uid").alias("seq")), comp)
    got = votes.predominant(x, "g", "final", F.col("share"))
    return got.withColumn("w", F.round("w", 6))


@R.query("composition_matrix_v8", f"select dataset, \"class\", final, share from ({_COMP})")
def _(s, d):
    return s.createDataFrame(profiles.composition_rows(), "dataset string, class string, final string, share double")


_SILH = "b as (select src u, dst v, 1 - ws d from edges union all select dst, src, 1 - ws from edges), l as (select index_reference g, row_id u, feed_id % 2 lab from group_sample where index_reference is not null)"


def _labelled(s, d):
    g = table(s, d, "group_sample").where("index_reference is not null").select(F.col("index_reference").alias("community"), F.col("row_id").alias("uid"), (F.col("feed_id") % 2).alias("label"))
    e = table(s, d, "edges").join(g.select("community", F.col("uid").alias("src")), "src").groupBy("community", "src", "dst").agg((1 - F.max("ws")).alias("d"))
    return e.select("community", F.col("src").alias("i"), F.col("dst").alias("j"), "d"), g


@R.query("silhouette_m4", "with l as (select index_reference g, row_id u, feed_id % 2 lab from group_sample where index_reference is not null), e as (select l.g, src, dst, 1 - max(ws) d from edges join l on l.u = src group by 1, 2, 3), b as (select g, src u, dst v, d from e union all select g, dst, src, d from e), m as (select b.g, b.u, lu.lab a, lv.lab c, avg(d) m from b join l lu on lu.g = b.g and lu.u = b.u join l lv on lv.g = b.g and lv.u = b.v group by 1, 2, 3, 4), p as (select g, u, max(case when a = c then m end) a, min(case when a <> c then m end) b from m group by 1, 2), k as (select g, count(distinct lab) k, count(*) n from l group by 1 having k > 1 and k < n) select l.g community, round(avg(coalesce(case when p.a is null then 0 else (p.b - p.a)/greatest(p.a, p.b) end, 0)), 6) silhouette from l join k using (g) left join p on p.g = l.g and p.u = l.u group by 1")
def _(s, d):
    pairs, labels = _labelled(s, d)
    return metrics.silhouette(pairs, labels).withColumn("silhouette", F.round("silhouette", 6))


@R.query("ari_m1", "with l as (select index_reference a, coalesce(class, '-') || feed_id b from group_sample where index_reference is not null), c as (select a, b, count(*) n from l group by 1, 2), ij as (select sum(n*(n - 1)/2.0) v, sum(n) n from c), sa as (select sum(n*(n - 1)/2.0) v from (select sum(n) n from c group by a)), sb as (select sum(n*(n - 1)/2.0) v from (select sum(n) n from c group by b)) select round((ij.v - sa.v*sb.v/(ij.n*(ij.n - 1)/2.0))/((sa.v + sb.v)/2 - sa.v*sb.v/(ij.n*(ij.n - 1)/2.0)), 6) ari from ij, sa, sb")
def _(s, d):
    g = table(s, d, "group_sample").where("index_reference is not null").select(F.col("index_reference").alias("a"), F.concat(F.coalesce("class", F.lit("-")), "feed_id").alias("b"))
    return metrics.adjusted_rand(g, "a", "b").withColumn("ari", F.round("ari", 6))


@R.query("ami_m2")
def _(s, d):
    g = table(s, d, "reference_polygons").select(F.col("class").alias("a"), F.coalesce("tree_type", F.lit("-")).alias("b"))
    return metrics.adjusted_mutual_information(g, "a", "b").withColumn("ami", F.round("ami", 6))


@R.query("davies_bouldin_m3", f"with {EVENTS_SQL}, c as (select class l, avg(cx) mx, avg(cy) my from ev group by 1), s as (select c.l, mx, my, avg(sqrt(pow(cx - mx, 2) + pow(cy - my, 2))) s from ev join c on c.l = ev.class group by 1, 2, 3), w as (select a.l, max((a.s + b.s)/sqrt(pow(a.mx - b.mx, 2) + pow(a.my - b.my, 2))) r from s a join s b on a.l <> b.l group by 1) select round(avg(r), 5) davies_bouldin from w")
def _(s, d):
    return metrics.davies_bouldin(events(s, d).withColumn("label", F.col("class"))).withColumn("davies_bouldin", F.round("davies_bouldin", 5))


@R.query("label_sizes_m6", "with n as (select index_reference c, case when class is null then -1 else feed_id end l, count(*) n from group_sample where index_reference is not null group by 1, 2) select round(sum(case when l = -1 then 1 else 0 end)/count(*), 6) noise_groups, round(sum(case when l = -1 then n else 0 end)/sum(n), 6) noise_rows from n")
def _(s, d):
    g = table(s, d, "group_sample").where("index_reference is not null").select(F.col("index_reference").alias("community"), F.when(F.col("class").isNull(), -1).otherwise(F.col("feed_id")).alias("label"))
    r = metrics.noise_rate(g)
    return r.select(*(F.round(c, 6).alias(c) for c in r.columns))


@R.query("precision_recall_m10", "with f as (select distinct index_reference k from group_sample where lower(trim(dataset)) = 'hm' and index_reference is not null), t as (select distinct index_reference k from group_sample where lower(trim(dataset)) = 'nfi' and index_reference is not null), c as (select count(*) hit from f join t using (k)) select round(hit/(select count(*) from f), 6) as precision, round(hit/(select count(*) from t), 6) recall, round(2.0*hit/((select count(*) from f) + (select count(*) from t)), 6) f1 from c")
def _(s, d):
    g = table(s, d, "group_sample").where("index_reference is not null").select(F.col("index_reference").alias("k"), F.expr("lower(trim(dataset))").alias("ds"))
    r = metrics.precision_recall(g.where("ds = 'hm'"), g.where("ds = 'nfi'"), ["k"])
    return r.select(*(F.round(c, 6).alias(c) for c in r.columns))


@R.query("purity_m11", "with n as (select index_reference c, coalesce(class, '-') k, count(*) n from group_sample where index_reference is not null group by 1, 2), p as (select c, n / sum(n) over (partition by c) p from n) select c, round(max(p), 6) purity, round(-sum(p*ln(p)), 6) + 0.0 entropy from p group by 1")
def _(s, d):
    g = table(s, d, "group_sample").where("index_reference is not null").select(F.col("index_reference").alias("c"), F.coalesce("class", F.lit("-")).alias("k"))
    return metrics.purity(g, "c", "k").select("c", F.round("purity", 6).alias("purity"), (F.round("entropy", 6) + 0.0).alias("entropy"))


_OFF = "(730 + abs(floor((a - b)/86400000000.0)))"
_PROFILE = "(case when x between 0 and 365 then 1.0 else 0.0 end + {})/2"


@R.query("temporal_period_e1")
def _(s, d):
    e = events(s, d).where("class != 'unknown'").withColumn("g", F.concat_ws("/", "class", "year"))
    return extent.temporal_period(e, "g").withColumn("threshold", F.round("threshold", 6))


@R.query("temporal_grid_e1", f"with {EVENTS_SQL}, g as (select class, min(start_us) a, max(end_us) b from ev group by 1), m as (select class, (a - {_OFF}*86400000000)::bigint lo, (b + {_OFF}*86400000000)::bigint hi from g), f as (select class, hi, lo + ((((3 - (floor(lo/86400000000.0))::bigint) % 7) + 7) % 7)*86400000000 first from m) select class, unnest(range(first, hi + 1, 1209600000000)) t_us from f where first <= hi")
def _(s, d):
    return extent.temporal_grid(events(s, d), "class")


@R.query("footprint_cells_e2")
def _(s, d):
    e = events(s, d).where("class != 'unknown'").withColumn("g", F.concat_ws("/", "class", "year"))
    return extent.footprint_cells(e, "g").withColumn("threshold", F.round("threshold", 6))


@R.query("footprints_e2")
def _(s, d):
    e = events(s, d).where("class != 'unknown'").withColumn("g", F.concat_ws("/", "class", "year"))
    return extent.footprints(e, "g")


@R.query("cluster_boxes_e5", "select class, min(minx) minx, min(miny) miny, max(maxx) maxx, max(maxy) maxy, count(*) n from reference_polygons group by 1")
def _(s, d):
    return extent.cluster_boxes(table(s, d, "reference_polygons"), "class")


@R.query("squares_e6", f"with {EVENTS_SQL} select uid, cx - 5000 minx, cy - 5000 miny, cx + 5000 maxx, cy + 5000 maxy from ev")
def _(s, d):
    return extent.squares(events(s, d)).select("uid", *BOX)


@R.query("geometry_measures_g1_g3", "select index_reference, true area_agrees, round(minx, 3) minx, round(miny, 3) miny, round(maxx, 3) maxx, round(maxy, 3) maxy from reference_polygons")
def _(s, d):
    m = table(s, d, "reference_polygons").select("index_reference", "area", geometry.measure("geometry").alias("m"))
    # the stored areas were summed from absolute coordinates and carry their rounding
    return m.select("index_reference", (F.abs(F.col("m.area") - F.col("area")) < 0.05).alias("area_agrees"), *(F.round(f"m.{c}", 3).alias(c) for c in BOX))


@R.query("polygon_shape_g7_g19")
def _(s, d):
    g = table(s, d, "reference_polygons").select("index_reference", geometry.measure("geometry").alias("m"), geometry.clear_cut_ok("geometry").alias("valid"), geometry.measure(geometry.simplified(30.0)("geometry")).alias("s"))
    return g.select("index_reference", "valid", "m.segments", "m.holes", "m.simple", "m.angles", F.round("m.hull_area", 2).alias("hull_area"), F.round(2 * F.ln("m.segments") / F.ln("m.area"), 6).alias("fractal"), F.col("s.segments").alias("simplified_segments"))


@R.query("polygon_distance_g4_g13")
def _(s, d):
    r = table(s, d, "reference_polygons").select("index_reference", "geometry", *BOX)
    pairs = spatial_join.within_distance(r, r, 5000.0).where("l_index_reference < r_index_reference")
    on = pairs.select(F.col("l_index_reference").alias("a"), F.col("r_index_reference").alias("b"), geometry.relate("l_geometry", "r_geometry").alias("x"))
    return on.select("a", "b", F.round("x.distance", 3).alias("distance"), F.round("x.overlap", 2).alias("overlap")).where("distance <= 5000")


@R.query("crs_g20", "select record_id, " + ", ".join(f"round({c}, 3) {n}" for c, n in ((X_SQL, "x"), (Y_SQL, "y"), ("6378137.0*radians(longitude)", "mx"), ("6378137.0*ln(tan(pi()/4 + radians(latitude)/2))", "my"))) + " from hm_reports")
def _(s, d):
    lon, lat = F.col("longitude"), F.col("latitude")
    (x, y), (mx, my) = planar.lambert93(lon, lat), planar.web_mercator(lon, lat)
    return table(s, d, "hm_reports").select("record_id", *(F.round(c, 3).alias(n) for n, c in (("x", x), ("y", y), ("mx", mx), ("my", my))))


@R.query("clear_cut_r3", f"with {PIXELS_SQL} select row, col, h2 <= 500 and ((h1 - h2 + 32768) % 65536) - 32768 between 500 and 27767 cut from pixels")
def _(s, d):
    p = pixels(s, d)
    return raster.clear_cut(p.select("row", "col", F.col("h1").alias("value")), p.select("row", "col", F.col("h2").alias("value")))


@R.query("height_drop_r4", f"with {PIXELS_SQL} select row, col, case when x < 8 then 0 when x < 10 then 1 when x <= 20 then 2 else 3 end k from (select *, (h1 - h2)/50.0 x from pixels)")
def _(s, d):
    return pixels(s, d).select("row", "col", raster.height_drop(F.col("h1") / 50.0, F.col("h2") / 50.0).alias("k"))


_FRAMES = "fr as (select (p_partkey % 40)::int as row, ((p_partkey // 40) % 5)::int as col, (p_partkey // 200)::int frame, (p_partkey*7 + p_size) % 6 as value from part)"


def _frames(s, d):
    return table(s, d, "part").select(
        (F.col("p_partkey") % 40).cast("int").alias("row"), (F.expr("p_partkey div 40") % 5).cast("int").alias("col"), F.expr("p_partkey div 200").cast("int").alias("frame"), ((F.col("p_partkey") * 7 + F.col("p_size")) % 6).alias("value")
    )


@R.query("drought_recovery_r5", f"with {_FRAMES} select row, col, sum(case when frame between 5 and 8 and value >= 4 then 1 else 0 end) >= 2 and sum(case when frame < 5 and value = 3 then 1 else 0 end) >= 1 recovered from fr where frame <= 8 group by 1, 2")
def _(s, d):
    return raster.drought_recovery(_frames(s, d), last=8, window=4, n=2, m=1)


@R.query("sliding_windows_w5", f"with {_FRAMES}, w as (select * from (values (0, 0, 3), (1, 3, 6), (2, 6, 9)) t(k, a, b)) select k as \"window\", row, col, count(*) n from fr join w on frame >= a and frame < b where value >= 4 group by 1, 2, 3 having count(*) >= 1")
def _(s, d):
    return raster.windowed(_frames(s, d), [(0, 3), (3, 6), (6, 9)], F.col("value") >= 4, 1)


@R.query("downsample_r6", f"with {PIXELS_SQL} select row // 3 as row, col // 3 col, round(avg(h1), 6) v from pixels group by 1, 2")
def _(s, d):
    p = pixels(s, d).select("row", "col", F.col("h1").alias("value"))
    return raster.downsample(p).select("row", "col", F.round("value", 6).alias("v"))


@R.query("crop_r7", f"with {PIXELS_SQL} select row, col, case when value <> 3 then value end v from pixels where row between 2 and 20 and col between 5 and 40")
def _(s, d):
    return raster.cropped(pixels(s, d).select("row", "col", "value"), 2, 20, 5, 40, 3).withColumnRenamed("value", "v")


@R.query("regions_r1", f"with recursive {PIXELS_SQL}, p as (select row, col, value v, row::bigint*64 + col uid from pixels), e as (select a.uid src, b.uid dst from p a join p b on a.v = b.v and ((b.row = a.row and b.col = a.col + 1) or (b.row = a.row + 1 and b.col = a.col))), {_COMPONENTS.format(e='e')}, l as (select p.*, coalesce(c, uid) g from p left join grown on u = uid) select g region, v as value, count(*) pixels, count(*)*900.0 area, round(avg(600000 + (col + 0.5)*30), 4) cx, round(avg(6700000 - (row + 0.5)*30), 4) cy from l group by 1, 2")
def _(s, d):
    shapes = raster.region_shapes(raster.regions(pixels(s, d).select("row", "col", "value"), 64), _AFFINE)
    return shapes.select("region", "value", "pixels", "area", F.round("cx", 4).alias("cx"), F.round("cy", 4).alias("cy"))


@R.query("affine_r9", f"with {PIXELS_SQL} select row, col, 600000 + 30.0*col x, 6700000 - 30.0*row y from pixels")
def _(s, d):
    x, y = planar.pixel_to_world(F.col("row").cast("double"), F.col("col").cast("double"), _AFFINE)
    return pixels(s, d).select("row", "col", x.alias("x"), y.alias("y"))


def _sampled(s, d):
    e = events(s, d).where("class != 'unknown'")
    region = F.concat(F.lit("r"), F.floor(F.col("cy") / 250_000).cast("int"))
    return e, e.select("uid", region.alias("region"), "class", (F.col("uid") % 500).alias("community"))


@R.query("stratified_t7")
def _(s, d):
    return sampling.stratified(_sampled(s, d)[1])


@R.query("stratified_limits_t7", f"with {EVENTS_SQL}, c as (select 'r' || floor(cy / 250000)::int region, class, uid % 500 community from ev where class <> 'unknown'), n as (select region, class, count(distinct community) k from c group by 1, 2) select region, class, true held from n")
def _(s, d):
    _, c = _sampled(s, d)
    drawn = sampling.stratified(c)
    # no community twice in a round and region, at most ten and eight of a class
    own = drawn.groupBy("region", "class", "round").agg(F.count("*").alias("n"), F.count_distinct("community").alias("k"))
    good = own.groupBy("region", "class").agg(F.min((F.col("n") <= F.when(F.col("round") == 1, 10).otherwise(8)) & (F.col("n") == F.col("k"))).alias("held"))
    return c.select("region", "class").distinct().join(good, ["region", "class"], "left").withColumn("held", F.coalesce("held", F.lit(True)))


def _placed(s, d):
    e, c = _sampled(s, d)
    drawn = sampling.stratified(c).select("uid", "community")
    groups = extent.cluster_boxes(e.withColumn("community", F.col("uid") % 500), "community").select("community", *(F.col(b).alias("k" + b) for b in BOX))
    placed = drawn.join(e.select("uid", "class", "cx", "cy", *BOX), "uid").join(groups, "community")
    return e, sampling.place_boxes(placed.withColumns({"kx": (F.col("kminx") + F.col("kmaxx")) / 2, "ky": (F.col("kminy") + F.col("kmaxy")) / 2}))


@R.query("boxes_t8")
def _(s, d):
    return _placed(s, d)[1]


@R.query("consumed_t8")
def _(s, d):
    return sampling.consumed(*_placed(s, d))


@R.query("area_by_species_v1", "with t as (select essence from reference_polygons where essence is not null group by 1 order by count(*) desc, essence limit 5) select class, essence, round(sum(area), 2) area from reference_polygons where essence in (select essence from t) group by 1, 2")
def _(s, d):
    from boskage.operators.relational import top_values

    r = table(s, d, "reference_polygons").select("class", "essence", "area")
    return r.join(F.broadcast(top_values(r, "essence", 5)), "essence", "left_semi").groupBy("class", "essence").agg(F.round(F.sum("area"), 2).alias("area"))


@R.query("class_share_v2", f"with {EVENTS_SQL} select class, count(*) n, round(count(*)/sum(count(*)) over (), 6) share from ev group by 1")
def _(s, d):
    e = events(s, d)
    return e.groupBy("class").agg(F.count("*").alias("n")).join(F.broadcast(e.agg(F.count("*").alias("t")))).select("class", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))


@R.query("squashed_v3", "select src, dst, round(1/(1 + exp(-coalesce(ws, 0))), 6) p from edges")
def _(s, d):
    return table(s, d, "edges").select("src", "dst", F.round(profiles.sigmoid(F.coalesce("ws", F.lit(0.0))), 6).alias("p"))


@R.query("coverage_v4", "select r.year, count(distinct r.index_reference) n_reference, count(distinct g.index_reference) n_attributed, round(count(distinct g.index_reference)/count(distinct r.index_reference), 6) coverage from reference_polygons r left join (select distinct index_reference from group_sample where lower(trim(dataset)) in ('hm', 'nfi', 'dfde')) g using (index_reference) group by 1")
def _(s, d):
    g = table(s, d, "group_sample").where("lower(trim(dataset)) in ('hm', 'nfi', 'dfde') and index_reference is not null").select("index_reference").distinct().withColumn("hit", F.lit(1))
    r = table(s, d, "reference_polygons").select("index_reference", "year").join(g, "index_reference", "left")
    return r.groupBy("year").agg(F.count("*").alias("n_reference"), F.count("hit").alias("n_attributed")).withColumn("coverage", F.round(F.col("n_attributed") / F.col("n_reference"), 6))


@R.query("class_by_source_v5", f"with {EVENTS_SQL} select dataset, class, year // 5 lustrum, count(*) n from ev group by 1, 2, 3")
def _(s, d):
    return events(s, d).groupBy("dataset", "class", F.expr("year div 5").alias("lustrum")).agg(F.count("*").alias("n"))


@R.query("mid_estimate_v9", f"with {EVENTS_SQL} select uid, year - 2.5 y from ev")
def _(s, d):
    return events(s, d).select("uid", (F.year(F.timestamp_micros("end_us")) - 2.5).alias("y"))


@R.query("multi_source_v10", "select index_reference, count(*) n, count(distinct lower(trim(dataset))) sources from group_sample where index_reference is not null group by 1 having count(distinct lower(trim(dataset))) > 3 and count(*) > 10")
def _(s, d):
    g = table(s, d, "group_sample").where("index_reference is not null").groupBy("index_reference").agg(F.count("*").alias("n"), F.count_distinct(F.expr("lower(trim(dataset))")).alias("sources"))
    return g.where("sources > 3 and n > 10")


def queries() -> dict:
    return dict(R.found)


def oracle_sql() -> dict[str, str]:
    return dict(R.sql)
