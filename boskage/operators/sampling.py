"""Stratified draws of clusters and placement of labelling boxes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _draw(rows: pd.DataFrame, most: dict[str, int], order: list[str], used: set) -> pd.DataFrame:
    out = []
    for cls in order:
        own = rows[rows["class"] == cls]
        taken = 0
        for r in own.itertuples():
            if taken >= most.get(cls, 0):
                break
            if r.community not in used:
                used.add(r.community)
                taken += 1
                out.append(r.uid)
    return rows[rows.uid.isin(out)]


def stratified(clusters: DataFrame, seed: int = 42, per_region: int = 10, second_most: int = 8) -> DataFrame:
    """Clusters (uid, region, class, community) drawn in two rounds, with column round.

    Round 1: in each region, classes from the most frequent, up to ``per_region`` clusters of
    a class, no community twice.  Round 2: what a class lacks to ``per_region`` times the
    number of regions is shared out by the clusters regions have left in communities that
    round 1 didn't use, at most ``second_most`` each.  The order within a class is a seeded
    hash; the candidates of a region are limited to what a draw can need before they are
    gathered: hash order per class and community.  What is left is counted over all clusters.
    """
    regions = clusters.select("region").distinct().count()
    w = Window.partitionBy("region", "class", "community").orderBy(F.xxhash64("uid", F.lit(seed)), "uid")
    one = clusters.where("region is not null and class is not null").withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
    keyed = one.withColumn("h", F.xxhash64("uid", F.lit(seed)))
    freq = clusters.groupBy("region", "class").agg(F.count("*").alias("freq"))
    # a region uses at most so many communities in both rounds that later candidates of a class can't be reached
    need = (clusters.select("class").distinct().count() + 1) * (per_region + second_most)
    rank = F.row_number().over(Window.partitionBy("region", "class").orderBy("h", "uid"))
    keyed = keyed.join(F.broadcast(freq), ["region", "class"]).withColumn("_r", rank).where(F.col("_r") <= need).drop("_r")
    schema = "uid bigint, region string, class string, community bigint, h bigint, round int"

    def first(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["h", "uid"])
        order = part.drop_duplicates("class").sort_values(["freq", "class"], ascending=[False, True])["class"].tolist()
        got = _draw(part, dict.fromkeys(order, per_region), order, set())
        return got.assign(round=1)[["uid", "region", "class", "community", "h", "round"]]

    round1 = keyed.groupBy("region").applyInPandas(first, schema)
    lack = round1.groupBy("class").agg(F.greatest(F.lit(0), F.lit(per_region * regions) - F.count("*")).alias("lack"))
    left = keyed.join(round1.select("region", "community").distinct(), ["region", "community"], "left_anti")
    whole = clusters.where("region is not null and class is not null").join(round1.select("region", "community").distinct(), ["region", "community"], "left_anti")
    have = whole.groupBy("region", "class").agg(F.count("*").alias("have"))
    share = have.join(F.broadcast(lack), "class").withColumn("all", F.sum("have").over(Window.partitionBy("class")))
    quota = share.select("region", "class", F.least(F.lit(second_most), F.round(F.col("have") / F.col("all") * F.col("lack"))).cast("int").alias("quota"))

    def second(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["h", "uid"])
        quotas = part.drop_duplicates("class").set_index("class").quota.to_dict()
        got = _draw(part, quotas, sorted(quotas), set())
        return got.assign(round=2)[["uid", "region", "class", "community", "h", "round"]]

    round2 = left.join(F.broadcast(quota), ["region", "class"]).groupBy("region").applyInPandas(second, schema)
    return round1.unionByName(round2).drop("h")


def place_boxes(samples: DataFrame, half: float = 5000.0, most: int = 20_000) -> DataFrame:
    """Labelling boxes for a bounded list of samples (uid, class, cx, cy), rarest class first.

    Samples may have their own box (minx, miny, maxx, maxy) and the centre and box of their
    community (kx, ky, kminx, kminy, kmaxx, kmaxy); without them they are points.  A sample is
    consumed, so skipped, when its box meets a box that was placed before.  The box is the
    square around the sample's centre, or around that of its community where the square of
    either is exactly its box (an intersection over union of 1).  Null boxes are those of
    points.  The placement is sequential by nature; its input is a sample whose size is checked.
    """
    from boskage.session import bounded_rows

    box, community = ("minx", "miny", "maxx", "maxy"), ("kx", "ky", "kminx", "kminy", "kmaxx", "kmaxy")
    rows = bounded_rows(samples.select("uid", "class", "cx", "cy", *(c for c in (*box, *community) if c in samples.columns)), most, "the sample")
    frequency: dict = {}
    for r in rows:
        frequency[r["class"]] = frequency.get(r["class"], 0) + 1
    width = 2 * half
    cells: dict[tuple[int, int], list[tuple[float, ...]]] = {}
    placed = []

    def own(r: dict, names: tuple[str, ...], x: float, y: float) -> tuple[float, ...]:
        found = tuple(r.get(n) for n in names)
        return (x, y, x, y) if None in found else found

    for r in sorted((r.asDict() for r in rows), key=lambda r: (frequency[r["class"]], str(r["class"]), r["uid"])):
        x1, y1, x2, y2 = own(r, box, r["cx"], r["cy"])
        covered = ((i, j) for i in range(int(x1 // width) - 1, int(x2 // width) + 2) for j in range(int(y1 // width) - 1, int(y2 // width) + 2))
        if any(b[0] <= x2 and x1 <= b[2] and b[1] <= y2 and y1 <= b[3] for c in covered for b in cells.get(c, ())):
            continue
        x, y = r["cx"], r["cy"]
        kx, ky = (r.get(n) if r.get(n) is not None else v for n, v in (("kx", x), ("ky", y)))
        around = lambda x, y: (x - half, y - half, x + half, y + half)
        if around(x, y) == (x1, y1, x2, y2) or around(kx, ky) == own(r, community[2:], kx, ky):
            x, y = kx, ky
        b = around(x, y)
        cells.setdefault((int(b[0] // width), int(b[1] // width)), []).append(b)
        placed.append((r["uid"], r["class"], *b))
    kind = samples.schema["uid"].dataType.simpleString()
    return samples.sparkSession.createDataFrame(placed, f"uid {kind}, class string, minx double, miny double, maxx double, maxy double")


def consumed(clusters: DataFrame, boxes: DataFrame) -> DataFrame:
    """(uid, box): clusters (uid and their box) that meet placed boxes, each with the box that comes first."""
    from boskage.operators.spatial_join import BOX, meeting

    pairs = meeting(clusters.select("uid", *BOX), boxes.select(F.col("uid").alias("box"), *BOX), 10_000.0, 2)
    return pairs.groupBy(F.col("l_uid").alias("uid")).agg(F.min("r_box").alias("box"))
