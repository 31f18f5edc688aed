"""Event tables made of the project's tables, alike in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boskage.functions import geometry, planar, wkt
from boskage.functions.temporal import micros
from boskage.operators.relational import first_per
from boskage.session import table

DAY_US = 86_400_000_000
_CLASSES = {"biotic-dieback": "Biotic-dieback", "biotic-mortality": "Biotic-mortality", "storm": "Storm", "fire": "Fire", "drought-dieback": "Drought-dieback", "other": "Other"}


def clean_class(c: str) -> Column:
    key = F.translate(F.lower(F.trim(F.col(c))), " _", "--")
    out = F.lit("unknown")
    for k, v in _CLASSES.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def reports(spark: SparkSession, d: str) -> DataFrame:
    """One row per report, as delivered: of several the most severe; rows without place or year are left out."""
    order = [F.desc_nulls_last("severity"), *(F.asc_nulls_last(c) for c in ("class", "essence", "tree_type", "cause", "notes", "year", "longitude", "latitude"))]
    one = first_per(table(spark, d, "hm_reports").where("record_id is not null"), ["record_id"], order)
    x, y = planar.lambert93(F.col("longitude"), F.col("latitude"))
    placed = one.where("year is not null and longitude is not null and latitude is not null")
    return placed.withColumns({"cx": F.round(x, 2), "cy": F.round(y, 2), "class": clean_class("class")})


def fires(spark: SparkSession, d: str) -> DataFrame:
    """One row per fire with a number and the box of its polygon."""
    one = table(spark, d, "fire_polygons").where("year is not null and start_date is not null").dropDuplicates(["uuid"])
    part = lambda k: F.split("uuid", "_")[k].cast("long")
    boxed = one.withColumn("b", geometry.boxed("geometry")).where("b is not null")
    uid = part(0) * 100_000_000_000 + part(1) * 1_000_000 + part(2)
    return boxed.select(uid.alias("uid"), "year", "start_date", "essence", F.coalesce("forest_area_m2", F.lit(0.0)).alias("area"), "geometry", "b.*")


def events(spark: SparkSession, d: str) -> DataFrame:
    """(uid, dataset, class, year, cx, cy, box, area, geometry, start_us, end_us, mid_us, r) of reports, reference polygons and fires.

    Reports are points and have a null geometry; reports and references last a year, fires a week.
    """
    day = F.unix_date(F.make_date("year", F.lit(1), F.lit(1))).cast("long")
    last = F.unix_date(F.make_date("year", F.lit(12), F.lit(31))).cast("long")
    hm = reports(spark, d).select(
        F.col("record_id").alias("uid"), F.lit("hm").alias("dataset"), "class", "year", "cx", "cy", "essence", "tree_type",
        F.col("cx").alias("minx"), F.col("cy").alias("miny"), F.col("cx").alias("maxx"), F.col("cy").alias("maxy"), F.lit(0.0).alias("area"), F.lit(None).cast("binary").alias("geometry"),
        (day * DAY_US).alias("start_us"), (last * DAY_US).alias("end_us"), F.lit(0.9).alias("r"),
    )
    mid = lambda c: F.round((F.col(f"min{c}") + F.col(f"max{c}")) / 2, 2).alias(f"c{c}")
    ref = table(spark, d, "reference_polygons").where("year is not null").select(
        F.col("index_reference").alias("uid"), F.lit("senfseidl").alias("dataset"), F.coalesce("class", F.lit("unknown")).alias("class"), "year",
        mid("x"), mid("y"), "essence", "tree_type", "minx", "miny", "maxx", "maxy", "area", "geometry",
        (day * DAY_US).alias("start_us"), (last * DAY_US).alias("end_us"), F.lit(0.7).alias("r"),
    )
    began = micros(F.col("start_date"))
    fire = fires(spark, d).select(
        "uid", F.lit("firepolygons").alias("dataset"), F.lit("Fire").alias("class"), "year", mid("x"), mid("y"), "essence", F.lit(None).cast("string").alias("tree_type"),
        "minx", "miny", "maxx", "maxy", "area", "geometry", began.alias("start_us"), (began + 7 * DAY_US).alias("end_us"), F.lit(1.0).alias("r"),
    )
    return hm.unionByName(ref).unionByName(fire).withColumn("mid_us", F.expr("(start_us + end_us) div 2"))


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """Three rasters of 64 columns from the part table."""
    p = table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("k"), F.col("p_size").cast("long").alias("s"))
    return p.select(
        F.expr("k div 64").cast("int").alias("row"), (F.col("k") % 64).cast("int").alias("col"), "k",
        ((F.col("k") * 7919 + F.col("s") * 37) % 1500).cast("int").alias("h1"), ((F.col("k") * 104729 + F.col("s") * 11) % 1500).cast("int").alias("h2"), ((F.expr("k div 3") * 31 + F.expr("k div 64") * 7) % 4).cast("int").alias("value"),
    )


N, E = float(wkt.N), float(wkt.E)
_T = f"(tan(pi()/4 - radians(latitude)/2) / pow((1 - {E!r}*sin(radians(latitude)))/(1 + {E!r}*sin(radians(latitude))), {E / 2!r}))"
X_SQL = f"({wkt.FALSE_EAST} + {float(wkt.SCALE)!r}*pow({_T}, {N!r})*sin({N!r}*radians(longitude - {wkt.LON_ORIGIN})))"
Y_SQL = f"({wkt.FALSE_NORTH} + {float(wkt.RHO_0)!r} - {float(wkt.SCALE)!r}*pow({_T}, {N!r})*cos({N!r}*radians(longitude - {wkt.LON_ORIGIN})))"
_CASE = "case translate(lower(trim(class)), ' _', '--') " + " ".join(f"when '{k}' then '{v}'" for k, v in _CLASSES.items()) + " else 'unknown' end"
REPORTS_SQL = f"""
reports as (
  select record_id, year, longitude, latitude, {_CASE} as class, essence, tree_type, severity, cause, round({X_SQL}, 2) cx, round({Y_SQL}, 2) cy
  from (select * from hm_reports where record_id is not null
        qualify row_number() over (partition by record_id order by severity desc nulls last, class nulls last, essence nulls last, tree_type nulls last, cause nulls last, notes nulls last, year nulls last, longitude nulls last, latitude nulls last) = 1)
  where year is not null and longitude is not null and latitude is not null)"""


def _little(h: str, at: str, size: int) -> str:
    """The little-endian whole number at a place of a text of hexadecimal digits."""
    return "('0x' || " + " || ".join(f"substr({h}, {at} + {2 * k}, 2)" for k in reversed(range(size))) + ")"


def _double(at: str) -> str:
    u = f"{_little('h', at, 8)}::ubigint"
    return f"(case when {u} >> 63 = 1 then -1.0 else 1.0 end * (1.0 + ({u} & 4503599627370495)::double / 4503599627370496.0) * pow(2.0, (({u} >> 52) & 2047)::double - 1023.0))"


# the polygons of both tables have one ring: order, kind, rings and points are 13 bytes, each point 16
RINGS_SQL = f"""
hx as (
  select index_reference uid, hex(geometry) h from reference_polygons where year is not null and geometry is not null
  union all
  select split_part(uuid, '_', 1)::bigint * 100000000000 + split_part(uuid, '_', 2)::bigint * 1000000 + split_part(uuid, '_', 3)::bigint, hex(any_value(geometry))
  from fire_polygons where year is not null and start_date is not null group by 1),
pt as (select uid, k, h, 27 + 32 * k as o from (select uid, h, unnest(range(0, {_little('h', '19', 4)}::int)) k from hx)),
xy as (select uid, k, {_double('o')} x, {_double('o + 16')} y from pt),
rings as (select uid, k, x x1, y y1, lead(x) over w x2, lead(y) over w y2 from xy window w as (partition by uid order by k) qualify x2 is not null)"""
EVENTS_SQL = f"""{REPORTS_SQL},{RINGS_SQL},
fires as (
  select split_part(uuid, '_', 1)::bigint * 100000000000 + split_part(uuid, '_', 2)::bigint * 1000000 + split_part(uuid, '_', 3)::bigint uid,
    any_value(year) as year, any_value(start_date) start_date, any_value(essence) essence, coalesce(any_value(forest_area_m2), 0.0) area
  from fire_polygons where year is not null and start_date is not null group by uuid),
events0 as (
  select record_id uid, 'hm' dataset, class, year, cx, cy, essence, tree_type, cx minx, cy miny, cx maxx, cy maxy, 0.0::double area, 0.9::double r,
    epoch_us(make_date(year, 1, 1)::timestamp) start_us, epoch_us(make_date(year, 12, 31)::timestamp) end_us from reports
  union all
  select index_reference, 'senfseidl', coalesce(class, 'unknown'), year, round((minx + maxx)/2, 2), round((miny + maxy)/2, 2), essence, tree_type, minx, miny, maxx, maxy, area, 0.7::double,
    epoch_us(make_date(year, 1, 1)::timestamp), epoch_us(make_date(year, 12, 31)::timestamp) from reference_polygons where year is not null
  union all
  select uid, 'firepolygons', 'Fire', any_value(year), round((min(x) + max(x))/2, 2), round((min(y) + max(y))/2, 2), any_value(essence), null, min(x), min(y), max(x), max(y), any_value(area), 1.0::double,
    epoch_us(any_value(start_date)), epoch_us(any_value(start_date)) + 604800000000 from fires join xy using (uid) group by 1),
ev as (select *, (start_us + end_us) // 2 mid_us from events0)"""


def _to_segment(x: str, y: str, s: str) -> str:
    dx, dy = f"({s}.x2 - {s}.x1)", f"({s}.y2 - {s}.y1)"
    t = f"greatest(0, least(1, coalesce((({x} - {s}.x1)*{dx} + ({y} - {s}.y1)*{dy}) / nullif({dx}*{dx} + {dy}*{dy}, 0), 0)))"
    return f"sqrt(pow({x} - {s}.x1 - {t}*{dx}, 2) + pow({y} - {s}.y1 - {t}*{dy}, 2))"


def _over(x: str, y: str, s: str) -> str:
    return f"(({s}.y1 > {y}) <> ({s}.y2 > {y}) and {x} < ({s}.x2 - {s}.x1)*({y} - {s}.y1)/({s}.y2 - {s}.y1) + {s}.x1)"


def _side(s: str, x: str, y: str) -> str:
    return f"(({s}.x2 - {s}.x1)*({y} - {s}.y1) - ({s}.y2 - {s}.y1)*({x} - {s}.x1))"


def gaps_sql(pairs: str, name: str) -> str:
    """A table (src, dst, gap) of the distances of the geometries of pairs (src, dst) of events, by all pairs of edges."""
    near = ", ".join(_to_segment(f"{p}.x{k}", f"{p}.y{k}", q) for p, q in (("a", "b"), ("b", "a")) for k in (1, 2))
    cross = f"{_side('a', 'b.x1', 'b.y1')} * {_side('a', 'b.x2', 'b.y2')} < 0 and {_side('b', 'a.x1', 'a.y1')} * {_side('b', 'a.x2', 'a.y2')} < 0"
    return f"""
{name}_sides as (select uid, k, x1, y1, x2, y2 from rings union all select uid, 0, cx, cy, cx, cy from ev where dataset = 'hm'),
{name} as (
  select src, dst, case when max(case when {cross} then 1 else 0 end) = 1 or sum(case when a.k = 0 and {_over('a.x1', 'a.y1', 'b')} then 1 else 0 end) % 2 = 1
    or sum(case when b.k = 0 and {_over('b.x1', 'b.y1', 'a')} then 1 else 0 end) % 2 = 1 then 0.0 else min(least({near})) end gap
  from (select distinct src, dst from {pairs}) p join {name}_sides a on a.uid = p.src join {name}_sides b on b.uid = p.dst group by 1, 2)"""


PIXELS_SQL = """
pixels as (select (p_partkey // 64)::int as row, (p_partkey % 64)::int as col, p_partkey k, ((p_partkey*7919 + p_size*37) % 1500)::int h1, ((p_partkey*104729 + p_size*11) % 1500)::int h2,
  (((p_partkey // 3)*31 + (p_partkey // 64)*7) % 4)::int as value from part)"""
