"""Queries of cluster tables, overlays, gates, scores and experiments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boskage.config import CLASS_SPREAD, COMPOSITION, SOURCE_PROFILES
from boskage.functions import geometry, profiles
from boskage.operators import cluster, experiments, extent, graph, spatial_join, votes
from boskage.plans import attribution, preprocess
from boskage.plans.carriers import EVENTS_SQL, events
from boskage.plans.registry import Registry
from boskage.session import stable, table

R = Registry()
_GROUPS = "g as (select distinct row_id u, index_reference c, feed_id from group_sample where index_reference is not null), e as (select g.c, src i, dst j, max(ws) s from edges join g on g.u = src group by 1, 2, 3)"


def _group_pairs(s, d):
    g = table(s, d, "group_sample").where("index_reference is not null").select(F.col("row_id").alias("uid"), F.col("index_reference").alias("community"), F.col("feed_id").alias("label"))
    e = table(s, d, "edges").join(g.select(F.col("uid").alias("src"), "community"), "src")
    return g, e.groupBy("community", F.col("src").alias("i"), F.col("dst").alias("j")).agg(F.max("ws").alias("s"))


@R.query("intra_similarity_a13", f"with {_GROUPS}, f as (select c, min(u) f from g group by 1), r as (select e.c, j u, s from e join f on f.c = e.c and e.i = f.f union all select e.c, i, s from e join f on f.c = e.c and e.j = f.f) select g.c community, g.feed_id as label, round(avg(case when g.u = f.f then 1.0 else coalesce(r.s, 0) end * 0.75), 8) intra from g join f on f.c = g.c left join r on r.c = g.c and r.u = g.u group by 1, 2")
def _(s, d):
    g, pairs = _group_pairs(s, d)
    return cluster.intra_similarity(g, pairs, F.lit(0.75)).withColumn("intra", F.round("intra", 8))


@R.query("dissimilarity_j23", f"with {_GROUPS} select c community, i, j, round(1 - s, 6) d from e")
def _(s, d):
    _, pairs = _group_pairs(s, d)
    return pairs.select("community", "i", "j", F.round(1 - F.col("s"), 6).alias("d"))


@R.query("cluster_table_c8")
def _(s, d):
    g, pairs = _group_pairs(s, d)
    found = cluster.cluster_similarities(pairs, g, "dbscan", eps=0.6)
    rows = table(s, d, "group_sample").select(F.col("row_id").alias("uid"), "class", "start_date", "end_date")
    members = found.join(rows, "uid")
    cls = votes.predominant(members.withColumn("seq", F.col("uid")).withColumn("k", F.struct("community", "label")), "k", "class", F.lit(1.0)).select("k.community", "k.label", "class")
    return cluster.cluster_table(members, cls, cluster.intra_similarity(found, pairs, F.col("probability"))).select("community", "label", "class", F.round("intra", 6).alias("intra"), "start_date", "end_date", F.size("indexes").alias("members"))


@R.query("clip_j16")
def _(s, d):
    r = table(s, d, "reference_polygons").where("maxx >= 400000 and minx <= 800000 and maxy >= 6300000 and miny <= 6900000")
    cut = r.select("index_reference", geometry.clipped_to(400000.0, 6300000.0, 800000.0, 6900000.0)("geometry").alias("g")).where("g is not null")
    return cut.select("index_reference", F.round(geometry.measure("g")["area"], 3).alias("area"))


@R.query("hull_e3")
def _(s, d):
    whole = extent.hulls(table(s, d, "reference_polygons"), ["class", "year"])
    return whole.select("class", "year", F.round(geometry.measure("hull")["area"], 1).alias("hull_area"))


@R.query("gating_k25", "with x as (select unnest(range(0, 61))::double x), p as (select x, case when x <= 7 then 1.0 else exp(-pow(x - 7, 2)/(2*pow(31/2.0, 2))) end f, exp(-0.5*pow(x/1095.0, 2)) g from x) select a.x, round(a.f*a.g, 6) product, round((select sum(b.f*c.g) from p b join p c on b.x + c.x = a.x), 6) convolution from p a")
def _(s, d):
    x = F.col("x")
    grid = s.range(61).select(F.col("id").cast("double").alias("x")).select("x", profiles.offset_gaussian(x, 7, 31).alias("f"), profiles.gaussian(x, 0, 1095).alias("g"))
    b, c = grid.select(F.col("x").alias("u"), F.col("f").alias("fu")), grid.select(F.col("x").alias("v"), F.col("g").alias("gv"))
    pairs = b.withColumn("x", F.explode(F.transform(F.sequence(F.lit(0), F.lit(60)), lambda k: k.cast("double")))).withColumn("v", F.col("x") - F.col("u")).join(F.broadcast(c), "v")
    conv = pairs.groupBy("x").agg(F.sum(F.col("fu") * F.col("gv")).alias("convolution"))
    return grid.join(conv, "x").select("x", F.round(F.col("f") * F.col("g"), 6).alias("product"), F.round("convolution", 6).alias("convolution"))


@R.query("regularity_k28", "select index_reference, round(7/sqrt(area/1e6/pi()), 6) score from reference_polygons where area > 0")
def _(s, d):
    return table(s, d, "reference_polygons").where("area > 0").select("index_reference", F.round(7 / F.sqrt(F.col("area") / 1e6 / F.pi()), 6).alias("score"))


_PLOT = {"NINCID": "(p_partkey * 7 + p_size) % 7", "DC": "case when p_partkey % 4 = 0 then p_size % 12 end", "PRELEV5": "case when p_partkey % 3 = 0 then p_size % 4 end", "VEGET": "case when p_partkey % 2 = 0 then p_size % 8 end", "ACCI": "case when p_partkey % 5 = 0 then p_size % 6 end", "OBSVEGET": "case when p_partkey % 3 = 1 then p_size % 8 end",
         "MORTB": "case when p_partkey % 6 = 0 then p_size % 5 end", "DPYR": "case when p_partkey % 7 = 0 then p_size % 3 end", "SFGUI": "case when p_partkey % 9 = 0 then p_size % 4 end", "SFCOEUR": "case when p_partkey % 11 = 0 then 1 end", "SFDORGE": "case when p_partkey % 13 = 0 then p_size % 3 end", "VEGET5": "case when p_partkey % 8 = 0 then p_size % 8 end",
         "HUMUS": "case when p_partkey % 10 = 0 then 40 + p_size % 4 end", "GEST": "case when p_partkey % 12 = 0 then p_size % 3 end", "ELAG": "case when p_partkey % 14 = 0 then p_size % 2 end", "DEF5": "case when p_partkey % 15 = 0 then p_size % 7 end", "INCID": "p_size % 5"}


def _score_sql() -> str:
    from boskage.plans.vocabulary import STRONG, WEAK

    hit = lambda rules: " + ".join([f"case when {c} in ({', '.join(repr(v) for v in vs)}) then 1 else 0 end" for c, vs in rules.items()] or ["0"])
    answered = lambda rules: " + ".join([f"case when {c} is null then 0 else 1 end" for c in rules] or ["0"])
    score = {c: f"(3*({hit(STRONG[c])}) + {hit(WEAK[c])})::double / case when 3*({answered(STRONG[c])}) + {answered(WEAK[c])} > 0 then 3*({answered(STRONG[c])}) + {answered(WEAK[c])} else 1000 end" for c in STRONG}
    cols = ", ".join(f"cast({e} as varchar) {c}" for c, e in _PLOT.items())
    names = {c: f"s{k}" for k, c in enumerate(score)}
    case = " ".join(f"when {n} = top then '{c}'" for c, n in names.items())
    return f"with p as (select p_partkey k, {cols} from part), s as (select k, {', '.join(f'{score[c]} {n}' for c, n in names.items())} from p), t as (select *, greatest({', '.join(names.values())}) top from s) select k, case when top > 0 then case {case} end end as class, round(top, 6) probability from t"


@R.query("inventory_score_k27", _score_sql())
def _(s, d):
    p = table(s, d, "part").select(F.col("p_partkey").alias("k"), *(F.expr(f"cast({e} as string)").alias(c) for c, e in _PLOT.items()))
    return preprocess.classify_inventory(p).select("k", "class", F.round("probability", 6).alias("probability"))


def profile_sql(x: str, dataset: str, cls: str, kind: str, datasets: tuple[str, ...] = ("hm", "senfseidl", "firepolygons")) -> str:
    """The profile a row's source and class select, as SQL."""
    spread = 0 if kind == "spatial" else 1
    forms = {
        "step": lambda a: f"case when {x} between {a['start']} and {a['end']} then 1.0 else 0.0 end",
        "offset_gaussian": lambda a: f"case when {x} <= {a['offset']} then 1.0 else exp(-pow({x} - {a['offset']}, 2)/(2*pow({a['decrease']}/2.0, 2))) end",
        "gaussian": lambda a: f"exp(-0.5*pow(({x} - {a['mean']})/{float(a['std'])!r}, 2))",
        "weighting_function": lambda a: f"case when {x} <= {a['x0']} then 1.0 else exp(-ln(2.0)*({x} - {a['x0']})/{a['k']}) end",
    }
    cases = []
    for d in datasets:
        name, args = SOURCE_PROFILES[d][kind]
        for c, mix in COMPOSITION[d].items():
            both = " + ".join(f"{share!r}::double*exp(-0.5*pow({x}/{float(CLASS_SPREAD[f][spread])!r}, 2))" for f, share in mix.items())
            cases.append(f"when {dataset} = '{d}' and {cls} = '{c}' then ({forms[name](args)} + {both})/2")
    return f"(case {' '.join(cases)} else 0.0 end)"


_OFF = "(730 + abs(floor((a - b)/86400000000.0)))"
_BY = "ev2 as (select *, class || '/' || year g from ev where class <> 'unknown')"
PERIOD_SQL = f"""with {EVENTS_SQL}, {_BY}, o as (select g, min(start_us) a, max(end_us) b, count(*) n from ev2 group by 1),
m as (select g, (a - {_OFF}*86400000000)::bigint lo, (b + {_OFF}*86400000000)::bigint hi from o),
f as (select g, hi, lo + ((((3 - (floor(lo/86400000000.0))::bigint) % 7) + 7) % 7)*86400000000 first from m),
t as (select g, unnest(range(first, hi + 1, 1209600000000)) t_us from f where first <= hi),
x as (select t.g, t.t_us, e.dataset, e.class, abs(floor((t.t_us - (e.start_us + (e.end_us - e.start_us)//2))/86400000000.0))::double x from t join ev2 e on e.g = t.g),
v as (select g, t_us, avg({profile_sql('x', 'dataset', 'class', 'temporal')}) v from x group by 1, 2),
q as (select *, quantile_cont(v, 0.9) over (partition by g) th, max(v) over (partition by g) top from v),
k as (select *, min(case when v = top then t_us end) over (partition by g) peak from q),
r as (select g, max(case when v <= th and t_us <= peak then t_us end) l, min(case when v <= th and t_us >= peak then t_us end) rr, max(th) th from k group by 1)
select o.g, case when n = 1 then a else l end left_us, case when n = 1 then b else rr end right_us, round(case when n = 1 then 1.0 else th end, 6) threshold from o left join r using (g)"""
CELLS_SQL = f"""with {EVENTS_SQL}, {_BY}, c as (select g, avg(cx) ox, avg(cy) oy from (select distinct g, cx, cy from ev2) group by 1),
h as (select g, greatest(max(maxx) - min(minx), max(maxy) - min(miny)) half from ev2 group by 1),
k as (select c.g, i, j, ox - half + i*(2*half/29) gx, oy - half + j*(2*half/29) gy from c join h using (g), (select unnest(range(0, 30)) i), (select unnest(range(0, 30)) j)),
x as (select k.*, e.dataset, e.class, sqrt(pow(gx - e.cx, 2) + pow(gy - e.cy, 2)) x from k join ev2 e using (g)),
v as (select g, i, j, avg({profile_sql('x', 'dataset', 'class', 'spatial')}) v from x group by 1, 2, 3)
select g, round(th, 6) threshold from (select g, quantile_cont(v, 0.9) th from v group by 1)"""


@R.query("footprint_threshold_e2", CELLS_SQL)
def _(s, d):
    e = events(s, d).where("class != 'unknown'").withColumn("g", F.concat_ws("/", "class", "year"))
    return extent.footprint_cells(e, "g").select("g", F.round("threshold", 6).alias("threshold"))


def _clusters(mode: str):
    """A labelling of stacked events: communities by weights of place and time, and density clusters inside them."""

    def run(e):
        pairs = spatial_join.candidate_pairs(e, 6000.0, 720)
        centres = F.sqrt(F.pow(F.col("l_cx") - F.col("r_cx"), 2) + F.pow(F.col("l_cy") - F.col("r_cy"), 2))
        weight = lambda x, kind: profiles.pair_weight(x, F.col("l_dataset"), F.col("l_class"), F.col("r_dataset"), F.col("r_class"), kind)
        nothing = F.lit(None).cast("double")
        on = pairs.select(
            F.col("l_uid").alias("src"), F.col("r_uid").alias("dst"), F.col("l_run").alias("run"),
            weight(centres, "spatial").alias("ws"), weight(F.col("days").cast("double"), "temporal").alias("wt"), nothing.alias("we"), nothing.alias("wc"),
        ).withColumn("weight", graph.weight_of(mode)).where("weight > 0")
        on = stable(on)
        totals = on.groupBy("run").agg(F.sum("weight").alias("total"))  # a row for each run
        found = stable(graph.louvain(on.join(F.broadcast(totals), "run").select("src", "dst", "weight", "total"), e.select("uid")))
        c = found.select(F.col("uid").alias("src"), "community")
        inside = on.join(c, "src").join(found.select(F.col("uid").alias("dst"), F.col("community").alias("other")), "dst").where("community = other")
        # of 2-D weights the mean is the similarity
        near = inside.select("community", F.col("src").alias("i"), F.col("dst").alias("j"), ((F.col("ws") + F.col("wt")) / 2).alias("s"))
        dense = cluster.dbscan_communities(near, found, 0.23)
        name = F.when(F.col("label") < 0, "noise").otherwise(F.concat_ws("/", F.expr(f"community div {experiments.MOST_RUNS}"), "label"))
        return dense.select("uid", "community", name.alias("label"))

    return run


@R.query("noise_sweep_m7")
def _(s, d):
    e = stable(events(s, d).drop("geometry"))
    sigmas = [round(600 * k / 9, 1) for k in range(10)]
    found = [experiments.noise_sweep(e, _clusters(mode), sigmas).withColumn("mode", F.lit(mode)) for mode in ("mean2", "pca", "eco")]
    return reduce(DataFrame.unionByName, found).select("mode", "sigma", *(F.round(c, 6).alias(c) for c in ("ari", "ami", "davies_bouldin")))


@R.query("stability_m8")
def _(s, d):
    r = experiments.stability(events(s, d).drop("geometry"), _clusters("mean2"), 200.0)
    return r.select("i", "j", F.round("ari", 6).alias("ari"), F.round("ami", 6).alias("ami"))


@R.query("threshold_sweep_m9", "select t threshold, count(*) filter (ws >= t) n from edges, (select unnest([0.2, 0.4, 0.6, 0.8])::double t) group by 1")
def _(s, d):
    e = table(s, d, "edges")
    return experiments.sweep([0.2, 0.4, 0.6, 0.8], lambda v: e.agg(F.sum((F.col("ws") >= v).cast("long")).alias("n")), "threshold")


@R.query("excerpt_s19", "select index_reference, minx, miny from reference_polygons where minx <= 469246.8845 and maxx >= 307783.0822 and miny <= 6419190.9011 and maxy >= 6340505.4366")
def _(s, d):
    box = "minx <= 469246.8845 and maxx >= 307783.0822 and miny <= 6419190.9011 and maxy >= 6340505.4366"
    return table(s, d, "reference_polygons").where(box).select("index_reference", "minx", "miny")


@R.query("polygon_parts_g10")
def _(s, d):
    p = table(s, d, "fire_polygons").select("uuid", F.posexplode(geometry.exploded("geometry")).alias("part", "g"))
    return p.select("uuid", "part", F.round(geometry.measure("g")["area"], 2).alias("area"))


@R.query("overlay_j15")
def _(s, d):
    # the polygons against the squares of a kilometre grid; the parts of a polygon add up to it
    cell = lambda c: F.sequence(F.floor(F.col(f"min{c}") / 1000), F.floor(F.col(f"max{c}") / 1000))
    r = table(s, d, "reference_polygons").select("index_reference", "geometry", *spatial_join.BOX).withColumn("cx", F.explode(cell("x"))).withColumn("cy", F.explode(cell("y")))
    square = geometry.box_wkb(F.col("cx") * 1000.0, F.col("cy") * 1000.0, F.lit(1000.0))
    on = r.select("index_reference", "cx", "cy", geometry.relate("geometry", square)["overlap"].alias("overlap"))
    return on.where("overlap > 0").withColumn("overlap", F.round("overlap", 2))


def queries() -> dict:
    return dict(R.found)


def oracle_sql() -> dict[str, str]:
    return dict(R.sql) | {"temporal_period_e1": PERIOD_SQL}
