"""Queries of the relational operators: filters, joins, aggregates, windows, order and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from boskage.config import COMPATIBLE
from boskage.operators import relational as rel
from boskage.operators import votes
from boskage.plans.carriers import DAY_US, EVENTS_SQL, REPORTS_SQL, events, reports
from boskage.plans.registry import Registry
from boskage.session import table

R = Registry()
DS = "lower(trim(dataset))"


@R.query("column_subset_p1", "select record_id, year, severity from hm_reports")
def _(s, d):
    return table(s, d, "hm_reports").select("record_id", "year", "severity")


@R.query("renamed_columns_p2", "select uuid uid, year annee, name commune, 'Fire' \"class\", cast(forest_area_m2 as bigint) area_m2 from fire_polygons")
def _(s, d):
    df = table(s, d, "fire_polygons").withColumnsRenamed({"uuid": "uid", "year": "annee", "name": "commune"})
    return df.select("uid", "annee", "commune", F.lit("Fire").alias("class"), F.round("forest_area_m2").cast("long").alias("area_m2"))


R.sql["renamed_columns_p2"] = "select uuid uid, year annee, name commune, 'Fire' \"class\", cast(round(forest_area_m2) as bigint) area_m2 from fire_polygons"


@R.query("scan_filter_p5", "select record_id, severity, class from hm_reports where severity > 1 and class in ('Biotic-dieback', 'Storm', 'Fire')")
def _(s, d):
    return table(s, d, "hm_reports").where((F.col("severity") > 1) & F.col("class").isin("Biotic-dieback", "Storm", "Fire")).select("record_id", "severity", "class")


@R.query("null_aware_filter_p7", "select record_id from hm_reports where (severity > 3 or severity is null) and not (class = 'Other')")
def _(s, d):
    return table(s, d, "hm_reports").where((F.col("severity").isNull() | (F.col("severity") > 3)) & ~(F.col("class") == "Other")).select("record_id")


@R.query(
    "overlap_filter_p8",
    "select uuid, start_date from fire_polygons where start_date <= timestamp '2012-12-31' + interval '17532 hours' and start_date + interval 7 day >= timestamp '2012-01-01' - interval '17532 hours'",
)
def _(s, d):
    pad = F.expr("interval 17532 hours")  # two years of 365.25 days
    low, high = F.expr("timestamp_ntz'2012-01-01'") - pad, F.expr("timestamp_ntz'2012-12-31'") + pad
    start = F.col("start_date")
    return table(s, d, "fire_polygons").where((start <= high) & (start + F.expr("interval 7 days") >= low)).select("uuid", "start_date")


@R.query("containment_p9", f"with {EVENTS_SQL} select uid, year from ev where year >= 2008 and year <= 2012")
def _(s, d):
    e = events(s, d)
    year = lambda c: F.year(F.timestamp_micros(c))
    return e.where((year("start_us") >= 2010 - 2) & (year("end_us") <= 2010 + 2)).select("uid", "year")


@R.query("overlap_year_p10", f"with {EVENTS_SQL} select uid from ev where start_us <= epoch_us(timestamp '2015-12-31') and end_us >= epoch_us(timestamp '2014-06-01')")
def _(s, d):
    at = lambda t: F.unix_micros(F.lit(t).cast("timestamp"))
    return events(s, d).where((F.col("start_us") <= at("2015-12-31")) & (F.col("end_us") >= at("2014-06-01"))).select("uid")


@R.query("area_filter_p11", "select index_reference, area from reference_polygons where area > 5000 and area <= 100000000")
def _(s, d):
    return table(s, d, "reference_polygons").where("area > 5000 and area <= 100e6").select("index_reference", "area")


@R.query("drop_nulls_p13", "select record_id, class from hm_reports where " + " and ".join(f"{c} is not null" for c in "record_id year longitude latitude cause notes severity class essence tree_type dataset".split()))
def _(s, d):
    return table(s, d, "hm_reports").dropna().select("record_id", "class")


@R.query("fill_nulls_p14", "select record_id, coalesce(class, 'None') \"class\", coalesce(essence, 'Unknown') essence from hm_reports")
def _(s, d):
    return table(s, d, "hm_reports").fillna({"class": "None", "essence": "Unknown"}).select("record_id", "class", "essence")


_CAUSE = "case when lower(cause) like '%sécheresse%' or lower(cause) like '%manque d''eau%' then 'Drought-dieback' when lower(cause) like '%feu %' then 'Fire' when lower(cause) like '%vent %' then 'Storm' when {} then 'Biotic' else 'Other' end"
_BIOTIC = ("maladie de l'encre", "chalarose", "chenille défoliatrice", "pourriture racinaire", "rouille foliaire", "oïdium du chêne", "scolyte typographe")
_CAUSE_SQL = _CAUSE.format("cause in (" + ", ".join("'" + b.replace("'", "''") + "'" for b in _BIOTIC) + ")")


def _caused():
    low = F.lower("cause")
    return rel.case_of(
        [(low.contains("sécheresse") | low.contains("manque d'eau"), "Drought-dieback"), (low.contains("feu "), "Fire"), (low.contains("vent "), "Storm"), (F.col("cause").isin(*_BIOTIC), "Biotic")],
        "Other",
    )


@R.query("classify_hm_p16", f"select record_id, {_CAUSE_SQL} kind from hm_reports")
def _(s, d):
    return table(s, d, "hm_reports").select("record_id", _caused().alias("kind"))


@R.query("severity_split_p16", f"select record_id, case when k = 'Biotic' then case when severity < 4 then 'Biotic-dieback' else 'Biotic-mortality' end else k end kind from (select *, {_CAUSE_SQL} k from hm_reports where severity is not null)")
def _(s, d):
    k = F.when(F.col("k") == "Biotic", F.when(F.col("severity") < 4, "Biotic-dieback").otherwise("Biotic-mortality")).otherwise(F.col("k"))
    return table(s, d, "hm_reports").where("severity is not null").withColumn("k", _caused()).select("record_id", k.alias("kind"))


@R.query("conditional_update_p17", "select record_id, case when class is null then 'Unknown' when severity >= 4 then class || '!' else class end c from hm_reports")
def _(s, d):
    c = F.when(F.col("class").isNull(), "Unknown").when(F.col("severity") >= 4, F.concat("class", F.lit("!"))).otherwise(F.col("class"))
    return table(s, d, "hm_reports").select("record_id", c.alias("c"))


@R.query("surrogate_key_p18", "select index_reference, row_number() over (order by index_reference) - 1 uid from reference_polygons")
def _(s, d):
    return rel.numbered(table(s, d, "reference_polygons").select("index_reference"), ["index_reference"])


@R.query("key_concat_p19", "select uuid, concat_ws('_', year, essence, name) k from fire_polygons")
def _(s, d):
    return table(s, d, "fire_polygons").select("uuid", F.concat_ws("_", F.col("year").cast("string"), "essence", "name").alias("k"))


@R.query("dictionary_lookup_p20", "select record_id, case tree_type when 'Conifer' then 'conifer' when 'Broadleaf' then 'broadleaf' when 'conifer' then 'conifer' when 'broadleaf' then 'broadleaf' end tree from hm_reports")
def _(s, d):
    known = F.create_map(*[F.lit(v) for v in ("Conifer", "conifer", "Broadleaf", "broadleaf", "conifer", "conifer", "broadleaf", "broadleaf")])
    return table(s, d, "hm_reports").select("record_id", known[F.col("tree_type")].alias("tree"))


@R.query("struct_unzip_p21", "select index_reference, minx lo, maxx hi from reference_polygons")
def _(s, d):
    return table(s, d, "reference_polygons").select("index_reference", F.struct(F.col("minx").alias("lo"), F.col("maxx").alias("hi")).alias("p")).select("index_reference", "p.lo", "p.hi")


@R.query("nway_join_j1", "select o.o_orderkey, c.c_custkey, l.l_linenumber from orders o join customer c on o.o_custkey = c.c_custkey join lineitem l on l.l_orderkey = o.o_orderkey")
def _(s, d):
    o, c, li = (table(s, d, t) for t in ("orders", "customer", "lineitem"))
    lines = rel.join_all([o.withColumnRenamed("o_orderkey", "k"), li.withColumnRenamed("l_orderkey", "k")], "k")
    return lines.join(c, lines.o_custkey == c.c_custkey).select(F.col("k").alias("o_orderkey"), "c_custkey", "l_linenumber")


@R.query("left_join_j2", "select g.row_id, f.tz_name from group_sample g left join feeds f on g.feed_id = f.feed_id")
def _(s, d):
    return table(s, d, "group_sample").select("row_id", "feed_id").join(table(s, d, "feeds").select("feed_id", "tz_name"), "feed_id", "left").select("row_id", "tz_name")


@R.query("reference_attach_j3", "select g.row_id, g.class, r.class class_ref, r.year year_ref from group_sample g join reference_polygons r using (index_reference)")
def _(s, d):
    ref = table(s, d, "reference_polygons").select("index_reference", F.col("class").alias("class_ref"), F.col("year").alias("year_ref"))
    return table(s, d, "group_sample").select("row_id", "class", "index_reference").join(ref, "index_reference").select("row_id", "class", "class_ref", "year_ref")


@R.query("comparison_j4", "select g.row_id, g.class = r.class same_class, lower(g.tree_type) = lower(r.tree_type) same_tree, not isnan(g.year) and abs(g.year - r.year) <= 1 close_year from group_sample g join reference_polygons r using (index_reference)")
def _(s, d):
    g = table(s, d, "group_sample").select("row_id", "index_reference", "class", "tree_type", "year").alias("g")
    r = table(s, d, "reference_polygons").alias("r")
    close = ~F.isnan("g.year") & (F.abs(F.col("g.year") - F.col("r.year")) <= 1)
    # a missing year compares to nothing
    close = F.when(F.col("g.year").isNotNull(), close)
    return g.join(r, F.col("g.index_reference") == F.col("r.index_reference")).select(
        "g.row_id", (F.col("g.class") == F.col("r.class")).alias("same_class"), (F.lower("g.tree_type") == F.lower("r.tree_type")).alias("same_tree"), close.alias("close_year")
    )


R.sql["comparison_j4"] = R.sql["comparison_j4"].replace("not isnan(g.year) and abs(g.year - r.year) <= 1 close_year", "case when g.year is not null then not isnan(g.year) and abs(g.year - r.year) <= 1 end close_year")


@R.query("semi_j7", "select index_reference from reference_polygons r where exists (select 1 from group_sample g where g.index_reference = r.index_reference and lower(trim(g.dataset)) = 'dfde')")
def _(s, d):
    g = table(s, d, "group_sample").where(f"{DS} = 'dfde'").select("index_reference")
    return table(s, d, "reference_polygons").join(g, "index_reference", "left_semi").select("index_reference")


@R.query("anti_j8", "select index_reference from reference_polygons r where not exists (select 1 from group_sample g where g.index_reference = r.index_reference and lower(trim(g.dataset)) = 'dfde')")
def _(s, d):
    g = table(s, d, "group_sample").where(f"{DS} = 'dfde'").select("index_reference")
    return table(s, d, "reference_polygons").join(g, "index_reference", "left_anti").select("index_reference")


@R.query(
    "interval_comparison_j13",
    "with f as (select year y, min(start_date) s, max(start_date) e from fire_polygons where year is not null group by 1) select a.y a, b.y b from f a join f b on a.y < b.y where not (a.e < b.s or a.s > b.e)",
)
def _(s, d):
    f = table(s, d, "fire_polygons").where("year is not null").groupBy(F.col("year").alias("y")).agg(F.min("start_date").alias("s"), F.max("start_date").alias("e"))
    a, b = f.select(*(F.col(c).alias("a_" + c) for c in f.columns)), f.select(*(F.col(c).alias("b_" + c) for c in f.columns))
    # one row per year on either side
    return a.join(F.broadcast(b), F.col("a_y") < F.col("b_y")).where("not (a_e < b_s or a_s > b_e)").select(F.col("a_y").alias("a"), F.col("b_y").alias("b"))


@R.query("index_list_j20", "select index_reference, row_id from group_sample where index_reference is not null")
def _(s, d):
    g = table(s, d, "group_sample").select("index_reference", "row_id", F.pmod("row_id", F.lit(64)).alias("salt")).where("index_reference is not null")
    lists = g.groupBy("index_reference", "salt").agg(F.collect_list("row_id").alias("indexes"))
    return lists.select("index_reference", F.explode("indexes").alias("row_id"))


@R.query("value_counts_a1", "select class, count(*) n from group_sample group by 1")
def _(s, d):
    return rel.counts(table(s, d, "group_sample"), "class")


@R.query("named_aggregates_a2", "select index_reference, min(start_date) first_text, max(end_date) last_text, count(*) n, min(row_id) low from group_sample group by 1")
def _(s, d):
    return table(s, d, "group_sample").groupBy("index_reference").agg(F.min("start_date").alias("first_text"), F.max("end_date").alias("last_text"), F.count("*").alias("n"), F.min("row_id").alias("low"))


@R.query("mean_a3", "select essence, round(avg(forest_area_m2), 6) mean_area from fire_polygons group by 1")
def _(s, d):
    return table(s, d, "fire_polygons").groupBy("essence").agg(F.round(F.avg("forest_area_m2"), 6).alias("mean_area"))


@R.query("first_nonnull_a4", "select index_reference, arg_min(cause, row_id) filter (cause is not null) cause from group_sample group by 1")
def _(s, d):
    return rel.first_non_null(table(s, d, "group_sample"), ["index_reference"], "cause", "row_id")


@R.query("sum_products_a5", "select src, round(sum(ws * wt), 6) sp from edges group by 1")
def _(s, d):
    return table(s, d, "edges").groupBy("src").agg(F.round(F.sum(F.col("ws") * F.col("wt")), 6).alias("sp"))


@R.query("distinct_values_a6", "select lower(trim(dataset)) ds, count(distinct class) classes, count(distinct index_reference) groups from group_sample group by 1")
def _(s, d):
    return table(s, d, "group_sample").groupBy(F.expr(DS).alias("ds")).agg(F.count_distinct("class").alias("classes"), F.count_distinct("index_reference").alias("groups"))


@R.query("listagg_a7", "select index_reference, coalesce(string_agg(distinct tree_type, ',' order by tree_type), '') trees from group_sample group by 1")
def _(s, d):
    return table(s, d, "group_sample").groupBy("index_reference").agg(F.array_join(F.sort_array(F.collect_set("tree_type")), ",").alias("trees"))


@R.query("percentile_kind_a8", "select class, round(quantile_cont(area, 0.95), 6) p95, round(median(area), 6) med, quantile_cont(area/1e6, 0.95) >= pi()*0.01 is_entity from reference_polygons group by 1")
def _(s, d):
    p = F.percentile("area", 0.95)
    return table(s, d, "reference_polygons").groupBy("class").agg(F.round(p, 6).alias("p95"), F.round(F.median("area"), 6).alias("med"), (F.percentile(F.col("area") / 1e6, 0.95) >= F.pi() * 0.01).alias("is_entity"))


@R.query("spread_a9", "with g as (select index_reference, count(*) n from group_sample group by 1) select round(stddev_pop(n), 6) sd, median(n) med, max(n) top from g")
def _(s, d):
    g = rel.counts(table(s, d, "group_sample"), "index_reference")
    return g.agg(F.round(F.stddev_pop("n"), 6).alias("sd"), F.median("n").alias("med"), F.max("n").alias("top"))


@R.query(
    "thresholded_mode_a10",
    "with c as (select index_reference, class, count(*) n from group_sample group by 1, 2), t as (select *, sum(n) over (partition by index_reference) t, row_number() over (partition by index_reference order by case when class is null then 1 else 0 end, n desc, class) k from c) select index_reference, case when n / t > 0.25 then class end as mode from t where k = 1",
)
def _(s, d):
    return votes.thresholded_mode(table(s, d, "group_sample"), "index_reference", "class")


_COMPAT = [(f, c) for f, cs in COMPATIBLE.items() for c in cs]
_COMPAT_SQL = "compat as (select * from (values " + ", ".join(f"('{f}', '{c}')" for f, c in _COMPAT) + ") t(final, cls))"
_WEIGHT = {"hm": 0.9, "nfi": 0.95, "dfde": 0.6, "senfseidl": 0.88, "forms": 0.8, "bdiff": 0.5, "firepolygons": 0.9, "cdi": 0.5}
_VOTES_SQL = f"""{_COMPAT_SQL},
rows_ as (select index_reference, class, case lower(trim(dataset)) {' '.join(f"when '{k}' then {v}" for k, v in _WEIGHT.items())} else 0.1 end p from group_sample where index_reference is not null and class is not null),
whole as (select index_reference, sum(p) al, count(*) n, avg(p) mean, min(case when class = 'Other' then 1 else 0 end) oo from rows_ group by 1),
per as (select index_reference, final, sum(p) own from rows_ join compat on class = cls group by 1, 2)"""


def _weighted(s, d):
    pairs = F.create_map(*[F.lit(v) for kv in _WEIGHT.items() for v in kv])
    g = table(s, d, "group_sample").where("index_reference is not null and class is not null")
    return g.select("index_reference", "class", F.coalesce(pairs[F.expr(DS)], F.lit(0.1)).alias("p")), s.createDataFrame(_COMPAT, "final string, class string")


@R.query("evidence_vote_a14", f"with {_VOTES_SQL} select index_reference, final, round(own/al, 6) p, n from per join whole using (index_reference) where oo = 0 and al > 0 union all select index_reference, 'Other', round(mean, 6), n from whole where oo = 1")
def _(s, d):
    rows, compat = _weighted(s, d)
    return votes.evidence(rows, "index_reference", "class", "p", compat).withColumn("p", F.round("p", 6))


@R.query("evidence_balance_a15", f"with {_VOTES_SQL} select index_reference, final, round((2*own - al)/n, 6) p, n from per join whole using (index_reference)")
def _(s, d):
    rows, compat = _weighted(s, d)
    return votes.evidence_balance(rows, "index_reference", "class", "p", compat).withColumn("p", F.round("p", 6))


@R.query("top_class_spread_a16", f"with {_VOTES_SQL}, v as (select index_reference, final, round(own/al, 9) p from per join whole using (index_reference) where oo = 0 and al > 0), t as (select *, row_number() over w k, lead(p) over w nx from v window w as (partition by index_reference order by p desc, final)) select index_reference, final, round(p, 6) p, round(coalesce(p - nx, 0), 6) spread from t where k = 1")
def _(s, d):
    rows, compat = _weighted(s, d)
    v = votes.evidence(rows, "index_reference", "class", "p", compat).where("final != 'Other'").withColumn("p", F.round("p", 9))
    return votes.top_class(v, "index_reference", "final", "p").withColumns({"p": F.round("p", 6), "spread": F.round("spread", 6)})


@R.query("dissolve_bounds_a17", "select class, year, count(*) n, min(minx) minx, min(miny) miny, max(maxx) maxx, max(maxy) maxy, round(sum(area), 3) area from reference_polygons group by 1, 2")
def _(s, d):
    r = table(s, d, "reference_polygons").groupBy("class", "year")
    return r.agg(F.count("*").alias("n"), F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"), F.round(F.sum("area"), 3).alias("area"))


@R.query("total_bounds_a18", "select min(minx) minx, min(miny) miny, max(maxx) maxx, max(maxy) maxy from reference_polygons")
def _(s, d):
    return table(s, d, "reference_polygons").agg(F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))


@R.query("temporal_range_a19", f"with {EVENTS_SQL} select dataset, class, min(start_us) first_us, max(end_us) last_us from ev group by 1, 2")
def _(s, d):
    return events(s, d).groupBy("dataset", "class").agg(F.min("start_us").alias("first_us"), F.max("end_us").alias("last_us"))


@R.query("isolated_a20", "select count(*) filter (e.src is null) alone, count(*) n from (select distinct row_id from group_sample) g left join (select src from edges union select dst from edges) e on g.row_id = e.src")
def _(s, d):
    from boskage.operators.graph import isolated

    v = table(s, d, "group_sample").select(F.col("row_id").alias("uid")).distinct()
    e = table(s, d, "edges").select("src", "dst")
    return isolated(v, e).agg(F.count("*").alias("alone")).join(F.broadcast(v.agg(F.count("*").alias("n"))))


@R.query("rates_a21", "select round(avg(case when class is null then 1 else 0 end), 6) missing, round(avg(case when index_reference is null then 1 else 0 end), 6) loose from group_sample")
def _(s, d):
    rate = lambda c: F.round(F.avg(F.col(c).isNull().cast("int")), 6)
    return table(s, d, "group_sample").agg(rate("class").alias("missing"), rate("index_reference").alias("loose"))


@R.query("pivot_a22", "select year, count(*) filter (class = 'Fire') fire, count(*) filter (class = 'Storm,Biotic') storm, count(*) filter (class = 'Other') other from reference_polygons group by 1")
def _(s, d):
    return rel.pivot_counts(table(s, d, "reference_polygons"), "year", "class", ["Fire", "Storm,Biotic", "Other"]).toDF("year", "fire", "storm", "other")


@R.query("dataset_class_a24", "select lower(trim(dataset)) ds, class, count(*) n, round(count(*) / sum(count(*)) over (partition by lower(trim(dataset))), 6) share from group_sample group by 1, 2")
def _(s, d):
    c = rel.counts(table(s, d, "group_sample").withColumn("ds", F.expr(DS)), "ds", "class")
    return c.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("ds")), 6))


@R.query("keep_max_w1", "select index_reference, row_id from (select *, max(loaded_at) over (partition by index_reference) m from group_sample where index_reference is not null) where loaded_at = m")
def _(s, d):
    g = table(s, d, "group_sample").select("index_reference", "row_id", "loaded_at").where("index_reference is not null")
    return rel.keep_max(g, ["index_reference"], "loaded_at").select("index_reference", "row_id")


@R.query("consecutive_w2", "select y a, lead(y) over (order by y) b from (select distinct year y from reference_polygons where year is not null) qualify b is not null")
def _(s, d):
    from boskage.operators.raster import consecutive

    return consecutive(table(s, d, "reference_polygons").where("year is not null"), "year")


@R.query("dedup_prefer_w3", "select record_id, row_id from (select record_id, row_id, row_number() over (partition by record_id order by loaded_at desc, row_id) k from group_sample) where k = 1")
def _(s, d):
    return rel.first_per(table(s, d, "group_sample").select("record_id", "row_id", "loaded_at"), ["record_id"], [F.desc("loaded_at"), "row_id"]).select("record_id", "row_id")


@R.query("kth_partner_w7", "with b as (select src u, dst v, 1 - ws d from edges union all select dst, src, 1 - ws from edges), t as (select u, d, row_number() over (partition by u order by d, v) k from b) select u uid, round(d, 6) d from t where k = 2")
def _(s, d):
    from boskage.operators.metrics import k_distance

    pairs = table(s, d, "edges").select(F.col("src").alias("i"), F.col("dst").alias("j"), (1 - F.col("ws")).alias("d"))
    return k_distance(pairs, 2).withColumn("d", F.round("d", 6))


@R.query("survival_w8", "select area, round(row_number() over (order by area) / (select count(*) from reference_polygons where area is not null), 9) share from reference_polygons where area is not null")
def _(s, d):
    return rel.survival(table(s, d, "reference_polygons"), "area").withColumn("share", F.round("share", 9))


@R.query("ordinal_w9", "select class, index_reference, row_number() over (partition by class order by index_reference) - 1 k from reference_polygons")
def _(s, d):
    r = table(s, d, "reference_polygons").select("class", "index_reference")
    return r.withColumn("k", F.row_number().over(Window.partitionBy("class").orderBy("index_reference")) - 1)


@R.query("sorted_t1", "select index_reference, area from reference_polygons order by area desc, index_reference")
def _(s, d):
    return table(s, d, "reference_polygons").select("index_reference", "area").orderBy(F.desc("area"), "index_reference")


@R.query("rarest_first_t2", "with c as (select class, count(*) n from reference_polygons group by 1) select index_reference, class, n from reference_polygons left join c using (class)")
def _(s, d):
    r = table(s, d, "reference_polygons").select("index_reference", "class")
    return r.join(F.broadcast(rel.counts(r.where("class is not null"), "class")), "class", "left").select("index_reference", "class", "n").orderBy("n", "class", "index_reference")


@R.query("head_t3", "select uid, dataset from (with " + EVENTS_SQL.strip() + " select * from ev) where dataset = 'hm' order by uid limit 20")
def _(s, d):
    return events(s, d).where("dataset = 'hm'").select("uid", "dataset").orderBy("uid").limit(20)


@R.query("top5_species_t4", "with t as (select essence from hm_reports where essence is not null group by 1 order by count(*) desc, essence limit 5) select record_id, essence from hm_reports where essence in (select essence from t)")
def _(s, d):
    h = table(s, d, "hm_reports").select("record_id", "essence")
    return h.join(F.broadcast(rel.top_values(h, "essence", 5)), "essence", "left_semi").select("record_id", "essence")


@R.query("argmax_t5", "select class, max(area) area, min(index_reference) filter (area = m) index_reference from (select *, max(area) over (partition by class) m from reference_polygons) group by 1")
def _(s, d):
    best = F.max(F.struct("area", (-F.col("index_reference")).alias("i"))).alias("b")
    return table(s, d, "reference_polygons").groupBy("class").agg(best).select("class", "b.area", (-F.col("b.i")).alias("index_reference"))


@R.query("seeded_sample_t6")
def _(s, d):
    return rel.hash_sample(table(s, d, "reference_polygons").select("index_reference", "class"), ["class"], "index_reference", 20)


@R.query("union_u1", "select record_id id, year, class, null::double area from hm_reports union all select index_reference, year, class, area from reference_polygons")
def _(s, d):
    a = table(s, d, "hm_reports").select(F.col("record_id").alias("id"), "year", "class")
    b = table(s, d, "reference_polygons").select(F.col("index_reference").alias("id"), "year", "class", "area")
    return rel.union_all([a, b])


@R.query("distinct_rows_u2", "select distinct * from hm_reports")
def _(s, d):
    return table(s, d, "hm_reports").distinct()


@R.query("distinct_keys_u3", "select record_id, min(row_id) row_id from group_sample group by 1")
def _(s, d):
    return table(s, d, "group_sample").groupBy("record_id").agg(F.min("row_id").alias("row_id"))


@R.query(
    "upsert_u4",
    "with n as (select record_id, severity from (select record_id, severity + 1 severity, row_number() over (partition by record_id order by severity) k from hm_reports where severity >= 4) where k = 1) select record_id, severity from hm_reports h where not exists (select 1 from n where n.record_id = h.record_id) union all select * from n",
)
def _(s, d):
    h = table(s, d, "hm_reports").select("record_id", "severity")
    new = h.where("severity >= 4").groupBy("record_id").agg((F.min("severity") + 1).alias("severity"))
    return rel.upsert(h, new, ["record_id"])


@R.query("common_keys_u5", f"with {REPORTS_SQL}, a as (select distinct class from reports), b as (select distinct class from reference_polygons) select class from a where class in (select class from b)")
def _(s, d):
    a, b = reports(s, d).select("class").distinct(), table(s, d, "reference_polygons").select("class").distinct()
    return a.join(b, "class", "left_semi")


@R.query("split_explode_s1", "select record_id, unnest(string_split(notes, ', ')) piece from hm_reports where notes is not null")
def _(s, d):
    return table(s, d, "hm_reports").where("notes is not null").select("record_id", F.explode(F.split("notes", ", ")).alias("piece"))


@R.query(
    "dates_d1_d12",
    "select uuid, epoch_us(start_date) us, epoch_us(start_date + interval 7 day) later_us, year(start_date) y, strftime(start_date, '%Y-%m-%d') as day, make_date(year, 1, 1) first_day, make_date(year, 12, 31) last_day, abs(year - year(start_date)) off, abs(date_diff('day', make_date(year, 1, 1), start_date::date)) n_days from fire_polygons",
)
def _(s, d):
    from boskage.functions import temporal as t

    us = t.micros(F.col("start_date"))
    first = t.year_start(F.col("year"))
    return table(s, d, "fire_polygons").select(
        "uuid", us.alias("us"), t.micros(t.shift_days(F.col("start_date"), 7)).alias("later_us"), F.year("start_date").alias("y"), F.date_format("start_date", "yyyy-MM-dd").alias("day"),
        first.alias("first_day"), t.year_end(F.col("year")).alias("last_day"), F.abs(F.col("year") - F.year("start_date")).alias("off"), F.abs(F.datediff("start_date", first)).alias("n_days"),
    )


@R.query(
    "parse_or_year_d3",
    "select row_id, coalesce(case when regexp_full_match(start_date, '[0-9]{4}-[0-9]{2}-[0-9]{2}') and not starts_with(start_date, '0000') then try_cast(start_date as date) end, case when year is not null and not isnan(year) then make_date(year::int, 1, 1) end) s from group_sample",
)
def _(s, d):
    plain = F.when(F.col("start_date").rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & ~F.col("start_date").startswith("0000"), F.col("start_date"))
    year = F.when(~F.isnan("year"), F.col("year"))
    return table(s, d, "group_sample").select("row_id", F.coalesce(plain.try_cast("date"), F.make_date(year.cast("int"), F.lit(1), F.lit(1))).alias("s"))


@R.query("midpoint_d1", f"with {EVENTS_SQL} select uid, start_us + (end_us - start_us)//2 mid_us, abs(floor((start_us - end_us)/86400000000.0))::bigint gap from ev")
def _(s, d):
    from boskage.functions import temporal as t

    e = events(s, d).select("uid", F.timestamp_micros("start_us").alias("a"), F.timestamp_micros("end_us").alias("b"))
    return e.select("uid", t.micros(t.midpoint(F.col("a"), F.col("b"))).alias("mid_us"), t.floor_days(F.col("a"), F.col("b")).alias("gap"))


assert DAY_US == 86_400_000_000


def queries() -> dict:
    return dict(R.found)


def oracle_sql() -> dict[str, str]:
    return dict(R.sql)
