"""Reliability-weighted votes, modes and top classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cluster_votes(members: DataFrame, targets: DataFrame, self_vote: float = 0.3) -> DataFrame:
    """(uid, class, p): for each target the share of every class among its cluster's reliability, itself voting a little more.

    Both tables have uid, cluster, class and r; a target's cluster with no weight gives nothing.
    """
    votes = members.groupBy("cluster", "class").agg(F.sum("r").alias("w"))
    shared = targets.select("uid", "cluster").join(votes, "cluster").select("uid", "class", "w")
    own = targets.select("uid", "class", (F.col("r") * self_vote).alias("w"))
    summed = shared.unionByName(own).groupBy("uid", "class").agg(F.sum("w").alias("w"))
    total = F.sum("w").over(Window.partitionBy("uid"))
    return summed.withColumn("t", total).where("t > 0").select("uid", "class", (F.col("w") / F.col("t")).alias("p"))


def as_map(votes: DataFrame) -> DataFrame:
    """(uid, probs): probabilities as a map."""
    return votes.groupBy("uid").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("class", "p")))).alias("probs"))


def predominant(entries: DataFrame, group: str, cls: str, weight: Column) -> DataFrame:
    """The class with the most entries, then the greatest mean weight, then the first to appear (column seq)."""
    per = entries.groupBy(group, cls).agg(F.count("*").alias("n"), F.avg(weight).alias("w"), F.min("seq").alias("_first"))
    w = Window.partitionBy(group).orderBy(F.desc("n"), F.desc("w"), "_first", cls)
    return per.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_first")


def thresholded_mode(df: DataFrame, group: str, value: str, least: float = 0.25) -> DataFrame:
    """The most frequent non-null value where it makes up more than ``least`` of all rows, nulls included; ties go to the lowest."""
    counts = df.groupBy(group, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(group)
    ranked = counts.withColumn("_total", F.sum("_n").over(w)).withColumn(
        "_k", F.row_number().over(w.orderBy(F.col(value).isNull().cast("int"), F.desc("_n"), value))
    )
    return ranked.where("_k = 1").select(group, F.when(F.col("_n") / F.col("_total") > least, F.col(value)).alias("mode"))


def evidence(rows: DataFrame, group: str, cls: str, p: str, compatible: DataFrame) -> DataFrame:
    """(group, final, p, n): weight of the compatible classes over all weight, and how many rows there are.

    ``compatible`` has (final, class); groups of ``Other`` only get the mean weight for it.
    """
    whole = rows.groupBy(group).agg(
        F.sum(p).alias("all"), F.count("*").alias("n"), F.avg(p).alias("mean"), F.min((F.col(cls) == "Other").cast("int")).alias("only_other")
    )
    per = rows.join(F.broadcast(compatible.withColumnRenamed("class", "_c")), F.col(cls) == F.col("_c")).groupBy(group, "final").agg(F.sum(p).alias("own"))
    voted = per.join(whole.where("only_other = 0"), group).where("all > 0").select(group, "final", (F.col("own") / F.col("all")).alias("p"), "n")
    return voted.unionByName(whole.where("only_other = 1").select(group, F.lit("Other").alias("final"), F.col("mean").alias("p"), "n"))


def evidence_balance(rows: DataFrame, group: str, cls: str, p: str, compatible: DataFrame) -> DataFrame:
    """(group, final, p, n): weight for minus weight against, over the number of rows."""
    whole = rows.groupBy(group).agg(F.sum(p).alias("all"), F.count("*").alias("n"))
    per = rows.join(F.broadcast(compatible.withColumnRenamed("class", "_c")), F.col(cls) == F.col("_c")).groupBy(group, "final").agg(F.sum(p).alias("own"))
    return per.join(whole, group).select(group, "final", ((2 * F.col("own") - F.col("all")) / F.col("n")).alias("p"), "n")


def top_class(votes: DataFrame, group: str, cls: str, p: str, single_spread: float | None = 0.0) -> DataFrame:
    """(group, class, p, spread): the most probable class and its lead over the next; ties go to the lowest name."""
    w = Window.partitionBy(group).orderBy(F.desc(p), cls)
    ranked = votes.withColumn("_k", F.row_number().over(w)).withColumn("_next", F.lead(p).over(w)).where("_k = 1")
    return ranked.select(group, cls, p, F.coalesce(F.col(p) - F.col("_next"), F.lit(single_spread)).alias("spread"))


def composition_entries(members: DataFrame, composition: DataFrame) -> DataFrame:
    """One row per member and final class its own class is composed of."""
    return members.join(F.broadcast(composition), ["dataset", "class"])
