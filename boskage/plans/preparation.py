"""Queries of the general data-preparation problems over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boskage.functions.timestamps import normalise_instants
from boskage.operators.intervals import periods_and_gaps
from boskage.operators.multivalue import split_values
from boskage.operators.proximity import located, near_rows
from boskage.session import bounded_rows, stable, table

#: Most names a reference list may have to be sent to all executors.
MOST_NAMES = 200_000
#: Most feeds likewise.
MOST_FEEDS = 100_000
RADIUS_M = 250.0


def dataset_key(column: str = "dataset") -> F.Column:
    """A dataset's name without case and surrounding blanks."""
    return F.lower(F.regexp_replace(F.col(column), r"^\s+|\s+$", ""))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = bounded_rows(table(spark, sf_dir, "species_ref").select("species_name").orderBy("species_id"), MOST_NAMES, "species_ref")
    return split_values(table(spark, sf_dir, "group_sample"), "row_id", "essence", [r[0] for r in names], at_least=2)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods_and_gaps(table(spark, sf_dir, "group_sample"), "index_reference", "start_date", "end_date", at_least=2)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "group_sample").select("row_id", "geometry", dataset_key().alias("side"))
    places = stable(located(rows.where(F.col("side").isin("hm", "nfi")), "row_id", "geometry", "side"))
    pairs = near_rows(places.where("side = 'hm'"), places.where("side = 'nfi'"), RADIUS_M)
    return pairs.select(F.least("a", "b").alias("row_id_a"), F.greatest("a", "b").alias("row_id_b"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    feeds = table(spark, sf_dir, "feeds").select("feed_id", "tz_name", "date_order")
    bounded_rows(feeds.select("feed_id"), MOST_FEEDS, "feeds")
    rows = table(spark, sf_dir, "group_sample").select("row_id", "feed_id", "start_date", "end_date", "year")
    known = rows.join(F.broadcast(feeds.dropDuplicates(["feed_id"])), "feed_id", "left")
    return normalise_instants(known, "row_id", ["start_date", "end_date"], "year", "tz_name", "date_order")


def queries() -> dict:
    return {"p2_found": p2_found, "p3_found": p3_found, "p4_found": p4_found, "p5_found": p5_found}


def oracle_sql() -> dict[str, str]:
    return {"p3_found": P3_SQL}


P3_SQL = """
with q as (
  select index_reference, try_cast(start_date as date) s, try_cast(end_date as date) e from group_sample
  where index_reference is not null
    and regexp_full_match(start_date, '[0-9]{4}-[0-9]{2}-[0-9]{2}') and regexp_full_match(end_date, '[0-9]{4}-[0-9]{2}-[0-9]{2}')
    and not starts_with(start_date, '0000') and not starts_with(end_date, '0000')),
v as (select * from q where s is not null and e is not null and e >= s),
k as (select * from (select *, count(*) over (partition by index_reference) n from v) where n >= 2),
d as (select index_reference, s, max(e) e from k group by 1, 2),
m as (select *, max(e) over (partition by index_reference order by s rows between unbounded preceding and 1 preceding) r from d),
i as (select *, sum(case when r is null or s > r + 1 then 1 else 0 end) over (partition by index_reference order by s rows unbounded preceding) g from m),
p as (select index_reference, g, min(s) a, max(e) b from i group by 1, 2),
n as (select *, lead(a) over (partition by index_reference order by a) nx from p)
select index_reference, 'period' as kind, strftime(a, '%Y-%m-%d') as first_day, strftime(b, '%Y-%m-%d') as last_day from n
union all
select index_reference, 'gap', strftime(b + 1, '%Y-%m-%d'), strftime(nx - 1, '%Y-%m-%d') from n where nx is not null
"""
