"""Samples that match target category proportions.

For each plan the wanted number of each class is spread over a second attribute in
proportion to what is there, which makes a two-way table of fractions.  Controlled rounding
turns it into whole numbers by a maximum flow: every cell becomes the floor or ceiling of its
fraction, every class keeps its quota exactly, and every second margin becomes the floor or
ceiling of its own sum.  Each cell then takes exactly its quota of sampling units, those with
the smallest random keys.

Plans are rounded independently, each from one small table of cells, so nothing but cell
counts is gathered.  The draw never sorts a cell: a histogram of key buckets, as many as the
cell needs and aggregated before the shuffle, gives the bucket where the cell's quota ends.
Units below it are taken and units beyond it dropped before any shuffle; only those of that
one bucket are ranked, so a cell may hold any share of all rows.

Defined cases: a quota above what is there is cut to what is there and reported as not met;
a null class or plan in the targets matches nothing; units without a key aren't drawn; a
null second attribute is a value of its own; two targets of a plan that name the same class
are drawn once, with the greater quota; empty tables give quotas that can't be met.
"""

from __future__ import annotations

from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boskage.session import stable

#: Most target rows that are sent to all executors.
MOST_TARGETS = 100_000
#: Most cells that are; beyond, they are joined by a shuffle.
MOST_CELLS = 1_000_000
#: Units that a bucket of random keys should hold in the draw.
BUCKET_UNITS = 2_000


def name_key(column: str) -> Column:
    """A name without case and surrounding blanks."""
    return F.lower(F.regexp_replace(F.col(column), r"^\s+|\s+$", ""))


def class_key(column: str) -> Column:
    """A class without case and surrounding blanks, with blank, ``_`` and ``-`` taken as the same."""
    return F.translate(name_key(column), " _", "--")


def augment(adjacent: list[dict[int, int]], source: int, sink: int) -> int:
    """Adds augmenting paths (breadth first, on residual capacities in place) until none is left; returns the added flow."""
    total = 0
    while True:
        parent, queue = {source: source}, [source]
        for u in queue:
            for v, free in adjacent[u].items():
                if free > 0 and v not in parent:
                    parent[v] = u
                    queue.append(v)
        if sink not in parent:
            return total
        path, v = [], sink
        while v != source:
            path.append((parent[v], v))
            v = parent[v]
        push = min(adjacent[u][v] for u, v in path)
        for u, v in path:
            adjacent[u][v] -= push
            adjacent[v][u] = adjacent[v].get(u, 0) + push
        total += push


def controlled_rounding(cells: list[list[Fraction]], rows: list[int]) -> list[list[int]]:
    """Whole numbers for a table of fractions whose rows sum to ``rows``.

    Cells become floor or ceiling, rows sum exactly, columns sum to the floor or ceiling of
    their fractions.  Such a table always exists and is found as a maximum flow in two steps:
    first up to the floors of the columns, then up to their ceilings.
    """
    n, m = len(cells), len(cells[0]) if cells else 0
    low = [[c.numerator // c.denominator for c in row] for row in cells]
    columns = [sum((cells[i][j] for i in range(n)), Fraction(0)) for j in range(m)]
    source, sink = n + m, n + m + 1
    adjacent: list[dict[int, int]] = [{} for _ in range(n + m + 2)]
    for i in range(n):
        adjacent[source][i] = rows[i] - sum(low[i])
        for j in range(m):
            if cells[i][j] != low[i][j]:
                adjacent[i][n + j] = 1
    taken = [sum(low[i][j] for i in range(n)) for j in range(m)]
    for j in range(m):
        adjacent[n + j][sink] = columns[j].numerator // columns[j].denominator - taken[j]
    augment(adjacent, source, sink)
    for j in range(m):
        adjacent[n + j][sink] += columns[j].denominator != 1
    augment(adjacent, source, sink)
    if any(adjacent[source][i] for i in range(n)):
        raise ArithmeticError("the rows don't sum to their quotas")
    return [[low[i][j] + (cells[i][j] != low[i][j] and adjacent[i][n + j] == 0) for j in range(m)] for i in range(n)]


def units(df: DataFrame, unit: str, group: str, category: str, second: str, latest: str, tie: str) -> DataFrame:
    """(g, c, u, s, r): one row per group, class and sampling unit, with the second attribute and row of its latest delivery."""
    src = df.select(
        name_key(group).alias("g"),
        class_key(category).alias("c"),
        F.col(unit).alias("u"),
        F.struct(F.col(latest).alias("at"), F.col(tie).alias("r"), F.col(second).cast("string").alias("s")).alias("x"),
    ).where("g is not null and c is not null and u is not null")
    return src.groupBy("g", "c", "u").agg(F.max("x").alias("x")).select("g", "c", "u", F.col("x.s").alias("s"), F.col("x.r").alias("r"))


def wanted(targets: DataFrame) -> DataFrame:
    """Targets with their quota: the larger of the minimum and the share of the sample size rounded up."""
    exact = F.coalesce(F.expr("(cast(target_permille as bigint) * sample_size + 999) div 1000"), F.lit(0).cast("long"))
    quota = F.greatest(F.coalesce(F.col("min_keep").cast("long"), F.lit(0).cast("long")), exact)
    return targets.select("plan_id", "class", name_key("dataset").alias("g"), class_key("class").alias("c"), quota.alias("quota"))


def allocate(sampled: DataFrame, targets: DataFrame) -> DataFrame:
    """(plan_id, class, g, c, s, t, quota, n, available, take) for each target ``t`` and value of the second attribute.

    ``sampled`` is the result of ``units``, n the units of a cell.  A target without any unit
    has one row with a null s and takes nothing.
    """
    if targets.limit(MOST_TARGETS + 1).count() > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    want = wanted(targets).withColumn("t", F.row_number().over(Window.partitionBy("plan_id").orderBy("class", "quota", "g")))
    groups = want.select("g", "c").where("g is not null and c is not null").distinct()
    cells = sampled.join(F.broadcast(groups), ["g", "c"], "left_semi").groupBy("g", "c", "s").agg(F.count("*").alias("n"))
    table = want.join(cells, ["g", "c"], "left").withColumn("n", F.coalesce("n", F.lit(0)))

    def solve(plan: pd.DataFrame) -> pd.DataFrame:
        plan = plan.reset_index(drop=True)
        text = lambda x: "" if pd.isna(x) else "=" + x
        seconds = {v: j for j, v in enumerate(sorted({text(s) for s in plan.s}))}
        classes: dict = {}
        for i, c in enumerate(plan.c):
            classes.setdefault(c if isinstance(c, str) else ("null", i), []).append(i)
        fractions, rows = [], []
        for places in classes.values():
            count = [0] * len(seconds)
            for i in places:
                count[seconds[text(plan.s[i])]] = int(plan.n[i])
            there = sum(count)
            quota = min(max(int(plan.quota[i]) for i in places), there)
            rows.append(quota)
            fractions.append([Fraction(quota * k, there) if there else Fraction(0) for k in count])
        rounded = controlled_rounding(fractions, rows)
        plan["available"], plan["take"] = 0, 0
        for r, places in enumerate(classes.values()):
            there = sum({seconds[text(plan.s[i])]: int(plan.n[i]) for i in places}.values())
            for i in places:
                plan.loc[i, "available"] = there
                plan.loc[i, "take"] = rounded[r][seconds[text(plan.s[i])]]
        return plan[["plan_id", "class", "g", "c", "s", "t", "quota", "n", "available", "take"]]

    kind = targets.schema["plan_id"].dataType.simpleString()
    return table.groupBy("plan_id").applyInPandas(
        solve, f"plan_id {kind}, class string, g string, c string, s string, t int, quota bigint, n bigint, available bigint, take bigint"
    )


def report(allocation: DataFrame) -> DataFrame:
    """(plan_id, class, quota, available, allocated): one row per target; not met where quota > allocated."""
    summed = allocation.groupBy("plan_id", "t", "class", "quota").agg(F.max("available").alias("available"), F.sum("take").alias("allocated"))
    return summed.select("plan_id", "class", "quota", "available", F.least("quota", "allocated").alias("allocated"))


def draw(sampled: DataFrame, allocation: DataFrame, seed: int = 11, bucket_units: int = BUCKET_UNITS) -> DataFrame:
    """(plan_id, c, s, u, r): exactly ``take`` units of every cell, those with the smallest random keys.

    The key is a hash of plan, unit and seed (ties by unit), so a draw can be repeated.
    """
    bits = F.greatest(F.lit(4), F.least(F.lit(40), F.ceil(F.log2(F.col("n") / bucket_units)).cast("int")))
    cell = ["plan_id", "g", "c", "s"]
    # two targets of one class share its cells, so the greatest take is that of both
    cells = stable(allocation.where("take > 0").groupBy(*cell).agg(F.max("take").alias("take"), F.max("n").alias("n")).withColumn("bits", bits))
    few = cells.count() <= MOST_CELLS

    def keyed(cells: DataFrame) -> DataFrame:
        k = (F.broadcast(cells) if few else cells).alias("k")
        rows = sampled.alias("x").join(k, F.expr("x.g = k.g and x.c = k.c and x.s <=> k.s"))
        rows = rows.select("k.*", "u", "r", F.xxhash64("plan_id", "u", F.lit(seed)).bitwiseXOR(F.lit(-(2**63))).alias("key"))
        # the top bits of the key in the order of the keys
        return rows.withColumn("bucket", F.expr("shiftright(key, 64 - bits)"))

    counted = keyed(cells).groupBy(*cell, "bucket").agg(F.count("*").alias("units"), F.first("take").alias("take"))
    before = F.coalesce(F.sum("units").over(Window.partitionBy(*cell).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = counted.withColumn("before", before).where("before < take and before + units >= take").select(*cell, F.col("bucket").alias("last"), (F.col("take") - F.col("before")).alias("rest"))
    same = " and ".join(f"k.{c} <=> l.{c}" for c in cell)
    # one row for each cell: where its quota ends
    ends = stable(cells.alias("k").join(last.alias("l"), F.expr(same)).select("k.plan_id", "k.g", "k.c", "k.s", "bits", "last", "rest"))
    hit = keyed(ends).where("bucket <= last")
    ranked = hit.where("bucket = last").withColumn("rank", F.row_number().over(Window.partitionBy(*cell).orderBy("key", "u"))).where("rank <= rest")
    cols = ["plan_id", "c", "s", "u", "r"]
    return hit.where("bucket < last").select(*cols).unionByName(ranked.select(*cols))


def class_margins(drawn: DataFrame) -> DataFrame:
    """(plan_id, class, drawn): units drawn of each class."""
    return drawn.groupBy("plan_id", F.col("c").alias("class")).agg(F.count("*").alias("drawn"))


def second_margins(drawn: DataFrame, allocation: DataFrame) -> DataFrame:
    """(plan_id, second, held): whether each value of the second attribute has the floor or ceiling of its share."""
    fraction = F.least("quota", "available") * F.col("n") / F.col("available")
    cells = allocation.where("n > 0").groupBy("plan_id", "g", "c", "s").agg(F.max(fraction).alias("x"))
    shares = cells.groupBy("plan_id", F.col("s").alias("second")).agg(F.sum("x").alias("x"))
    own = drawn.groupBy(F.col("plan_id").alias("p"), "s").agg(F.count("*").alias("k"))
    k = F.coalesce("k", F.lit(0))
    joined = shares.join(own, F.expr("plan_id <=> p and second <=> s"), "left")
    return joined.select("plan_id", "second", ((k >= F.floor(F.col("x") - 1e-6)) & (k <= F.ceil(F.col("x") + 1e-6))).alias("held"))
