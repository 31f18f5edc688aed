"""Relational building blocks with defined orders and null rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union by column name; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def join_all(frames: list[DataFrame], key: str) -> DataFrame:
    return reduce(lambda a, b: a.join(b, key), frames)


def numbered(df: DataFrame, order: list[str], name: str = "uid") -> DataFrame:
    """Consecutive numbers from 0 in a total order, without bringing the rows into one task.

    The rows are sorted by range; the sizes of the ranges (as many as partitions) give each
    range its offset.
    """
    from boskage.session import stable

    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    part = stable(ranged.withColumn("_id", F.monotonically_increasing_id()))
    place = part.withColumns({"_p": F.shiftright("_id", 33), "_k": F.col("_id").bitwiseAND((1 << 33) - 1)})
    sizes = sorted((r["_p"], r["n"]) for r in place.groupBy("_p").agg(F.count("*").alias("n")).collect())
    base, total = {}, 0
    for p, n in sizes:
        base[p], total = total, total + n
    shift = df.sparkSession.createDataFrame(list(base.items()) or [(0, 0)], "_p long, _b long")
    return place.join(F.broadcast(shift), "_p").withColumn(name, F.col("_k") + F.col("_b")).drop("_p", "_b", "_k", "_id")


def first_per(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in an order, which should be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def first_non_null(group: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The first non-null value of each group in an order; null where there is none."""
    return group.groupBy(*keys).agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias(value))


def keep_max(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """All rows that have the greatest value of their group; rows with a null key or value are left out.

    The maxima are aggregated before the shuffle and joined back, so a hot group isn't one task's.
    """
    return df.join(df.groupBy(*keys).agg(F.max(value).alias(value)), [*keys, value], "left_semi")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The old rows whose key isn't among the new ones, and the new rows."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values; ties go to the lowest."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def pivot_counts(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """A table of counts with one column per value, 0 where there is nothing."""
    return df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).fillna(0)


def survival(df: DataFrame, value: str) -> DataFrame:
    """(value, share): share of rows up to each rank of the sorted values."""
    n = df.where(F.col(value).isNotNull()).agg(F.count("*").alias("n"))
    own = numbered(df.where(F.col(value).isNotNull()).select(value), [value], "k")
    return own.join(F.broadcast(n)).select(value, ((F.col("k") + 1) / F.col("n")).alias("share"))


def case_of(rules: list[tuple[Column, str]], otherwise: str | None) -> Column:
    """The first rule that holds names the value."""
    out = F.lit(otherwise)
    for condition, value in reversed(rules):
        out = F.when(condition, value).otherwise(out)
    return out


def hash_sample(df: DataFrame, groups: list[str], key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of each group, those with the lowest seeded hash; repeatable."""
    w = Window.partitionBy(*groups).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")
