"""Period, footprint and boxes of clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boskage.functions.profiles import profile_of

DAY_US = 86_400_000_000


def temporal_grid(members: DataFrame, group: str) -> DataFrame:
    """(group, t_us): instants two weeks apart, on Sundays, around the members' dates.

    The grid starts at the first Sunday not before the earliest start less a margin of two
    years and the whole span, and keeps that start's time of day.
    """
    own = members.groupBy(group).agg(F.min("start_us").alias("a"), F.max("end_us").alias("b"))
    margin = (F.lit(730) + F.abs(F.floor((F.col("a") - F.col("b")) / F.lit(DAY_US)))) * F.lit(DAY_US)
    low, high = F.col("a") - margin, F.col("b") + margin
    # 1970-01-04 was a Sunday
    wait = F.pmod(F.lit(3) - F.floor(F.col("low") / F.lit(DAY_US)), F.lit(7)) * F.lit(DAY_US)
    grid = own.select(group, low.cast("long").alias("low"), high.cast("long").alias("high")).withColumn("first", (F.col("low") + wait).cast("long"))
    return grid.where("first <= high").select(group, F.explode(F.sequence("first", "high", F.lit(14 * DAY_US))).alias("t_us"))


def temporal_profile(members: DataFrame, group: str, weight: Column | None = None) -> DataFrame:
    """(group, t_us, v): the members' mean temporal profile on the grid; weighted by ``weight`` where given."""
    grid = temporal_grid(members, group)
    mid = (F.col("start_us") + F.floor((F.col("end_us") - F.col("start_us")) / 2)).cast("long")
    w = (weight if weight is not None else F.lit(1.0)).alias("_w")
    # members that share middle, source and class have one profile
    alike = members.select(group, mid.alias("_mid"), "dataset", "class", w).groupBy(group, "_mid", "dataset", "class").agg(F.sum("_w").alias("_w"))
    days = F.abs(F.floor((F.col("t_us") - F.col("_mid")) / F.lit(DAY_US))).cast("double")
    on = grid.join(alike, group).withColumn("x", days)
    v = profile_of(F.col("x"), F.col("dataset"), F.col("class"), "temporal")
    return on.groupBy(group, "t_us").agg((F.sum(v * F.col("_w")) / F.sum("_w")).alias("v"))


def temporal_period(members: DataFrame, group: str, weight: Column | None = None) -> DataFrame:
    """(group, left_us, right_us, threshold): where the profile first falls to its 90th percentile on either side of its peak.

    Unweighted groups of one member keep their own dates (threshold 1); weighted groups
    without weight get the span of their members (threshold 0).
    """
    values = temporal_profile(members, group, weight)
    w = Window.partitionBy(group)
    marked = (
        values.withColumn("threshold", F.percentile("v", 0.9).over(w))
        .withColumn("top", F.max("v").over(w))
        .withColumn("peak", F.min(F.when(F.col("v") == F.col("top"), F.col("t_us"))).over(w))
    )
    low = F.col("v") <= F.col("threshold")
    found = marked.groupBy(group).agg(
        F.max(F.when(low & (F.col("t_us") <= F.col("peak")), F.col("t_us"))).alias("left_us"),
        F.min(F.when(low & (F.col("t_us") >= F.col("peak")), F.col("t_us"))).alias("right_us"),
        F.first("threshold").alias("threshold"),
    )
    total = F.sum(weight) if weight is not None else F.count("*").cast("double")
    own = members.groupBy(group).agg(F.count("*").alias("n"), total.alias("total"), F.min("start_us").alias("s"), F.max("end_us").alias("e"))
    plain = (F.col("n") == 1) if weight is None else (F.col("total") == 0)
    pick = lambda a, b: F.when(plain, a).otherwise(b)
    return own.join(found, group, "left").select(
        group, pick(F.col("s"), F.col("left_us")).alias("left_us"), pick(F.col("e"), F.col("right_us")).alias("right_us"),
        pick(F.lit(1.0 if weight is None else 0.0), F.col("threshold")).alias("threshold"),
    )


def spatial_grid(members: DataFrame, group: str, size: int = 30) -> DataFrame:
    """(group, i, j, gx, gy): a square grid around the mean of the distinct centres, as wide as twice the larger extent."""
    centres = members.select(group, "cx", "cy").distinct().groupBy(group).agg(F.avg("cx").alias("ox"), F.avg("cy").alias("oy"))
    extent = members.groupBy(group).agg(F.greatest(F.max("maxx") - F.min("minx"), F.max("maxy") - F.min("miny")).alias("half"))
    grid = centres.join(extent, group)
    axis = F.sequence(F.lit(0), F.lit(size - 1))
    on = grid.withColumn("i", F.explode(axis)).withColumn("j", F.explode(axis))
    at = lambda o, k: F.col(o) - F.col("half") + F.col(k) * (2 * F.col("half") / (size - 1))
    return on.select(group, "i", "j", at("ox", "i").alias("gx"), at("oy", "j").alias("gy"))


#: Different members of a group that meet its grid in one slice.
SLICE = 2_000


def spatial_profile(members: DataFrame, group: str, size: int = 30) -> DataFrame:
    """(group, i, j, gx, gy, v): the members' mean spatial profile on the grid.

    Members that share place, source and class have one profile and are counted; those of a
    large group meet copies of its grid in slices, so no group is one task's.
    """
    alike = members.groupBy(group, "cx", "cy", "dataset", "class").agg(F.count("*").alias("_n"))
    slices = alike.groupBy(group).agg(F.ceil(F.count("*") / SLICE).cast("int").alias("_slices"))
    own = alike.join(slices, group).withColumn("_slice", F.pmod(F.xxhash64("cx", "cy"), F.col("_slices")).cast("int")).drop("_slices")
    grid = spatial_grid(members, group, size).join(slices, group).withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1))).drop("_slices")
    on = grid.join(own, [group, "_slice"])
    x = F.sqrt(F.pow(F.col("gx") - F.col("cx"), 2) + F.pow(F.col("gy") - F.col("cy"), 2))
    v = profile_of(F.col("x"), F.col("dataset"), F.col("class"), "spatial")
    return on.withColumn("x", x).groupBy(group, "i", "j", "gx", "gy").agg((F.sum(v * F.col("_n")) / F.sum("_n")).alias("v"))


def footprint_cells(members: DataFrame, group: str, size: int = 30) -> DataFrame:
    """(group, threshold, cells): the 90th percentile of the profile and the number of grid points at or above it."""
    values = spatial_profile(members, group, size).withColumn("threshold", F.percentile("v", 0.9).over(Window.partitionBy(group)))
    return values.groupBy(group).agg(F.first("threshold").alias("threshold"), F.sum((F.col("v") >= F.col("threshold")).cast("int")).alias("cells"))


def contour_segments(v: np.ndarray, x: np.ndarray, y: np.ndarray, level: float) -> list[np.ndarray]:
    """Closed outlines of the region at or above a level, by marching squares on a padded grid."""
    low = min(float(v.min()), level) - 1.0
    p = np.pad(v, 1, constant_values=low)
    px = np.concatenate([[2 * x[0] - x[1]], x, [2 * x[-1] - x[-2]]])
    py = np.concatenate([[2 * y[0] - y[1]], y, [2 * y[-1] - y[-2]]])
    follow: dict[tuple, list[tuple]] = {}
    n, m = p.shape
    for i in range(n - 1):
        for j in range(m - 1):
            corners = [(i, j), (i + 1, j), (i + 1, j + 1), (i, j + 1)]
            on = [p[c] >= level for c in corners]
            cuts = [(corners[k], corners[(k + 1) % 4], on[k]) for k in range(4) if on[k] != on[(k + 1) % 4]]
            key = lambda c: tuple(sorted(c[:2]))
            leaving, entering = [c for c in cuts if c[2]], [c for c in cuts if not c[2]]
            for a, b in zip(leaving, entering if len(entering) < 2 else entering):
                follow.setdefault(key(a), []).append(key(b))

    def place(edge: tuple) -> tuple[float, float]:
        (a, b), va, vb = edge, p[edge[0]], p[edge[1]]
        t = (level - va) / (vb - va) if vb != va else 0.5
        return px[a[0]] + t * (px[b[0]] - px[a[0]]), py[a[1]] + t * (py[b[1]] - py[a[1]])

    rings = []
    while follow:
        start = next(iter(follow))
        ring, at = [], start
        while at in follow:
            ring.append(place(at))
            options = follow[at]
            nxt = options.pop()
            if not options:
                del follow[at]
            at = nxt
        if len(ring) >= 3:
            rings.append(np.array(ring))
    return rings


def footprints(members: DataFrame, group: str, size: int = 30, tolerance: float = 10.0) -> DataFrame:
    """(group, geometry): outlines of the grid region at or above the 90th percentile, simplified."""
    from boskage.functions.geometry import MULTIPOLYGON, signed_area, simplify, write_wkb

    values = spatial_profile(members, group, size)
    kind = members.schema[group].dataType.simpleString()

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["i", "j"])
        k = part.i.nunique()
        v = part.v.to_numpy().reshape(k, -1)
        rings = contour_segments(v, np.sort(part.gx.unique()), np.sort(part.gy.unique()), float(np.percentile(v, 90))) if part.gx.nunique() == k > 1 else []
        parts = simplify([[r] for r in rings if abs(signed_area(r)) > 0], tolerance)
        return pd.DataFrame({group: [part[group].iloc[0]], "geometry": [write_wkb(parts, MULTIPOLYGON) if parts else None]})

    return values.groupBy(group).applyInPandas(solve, f"`{group}` {kind}, geometry binary")


def without_large(members: DataFrame, group: str) -> DataFrame:
    """Members without those of large-entity sources, in groups that have any other member."""
    other = F.max((~F.col("is_entity")).cast("int")).over(Window.partitionBy(group))
    return members.withColumn("_o", other).where("not is_entity or _o = 0").drop("_o")


def cluster_boxes(members: DataFrame, group: str) -> DataFrame:
    return members.groupBy(group).agg(F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"), F.count("*").alias("n"))


def squares(df: DataFrame, half: float = 5000.0) -> DataFrame:
    """The square of 10 km around each centre."""
    return df.withColumns({"minx": F.col("cx") - half, "miny": F.col("cy") - half, "maxx": F.col("cx") + half, "maxy": F.col("cy") + half})


def hulls(df: DataFrame, keys: list[str], geometry: str = "geometry") -> DataFrame:
    """(keys, hull): the convex hull of each group's WKB geometries, null where a group has none.

    Each partition first reduces its rows to one hull per group, so a group reaches its task as
    at most as many hulls as there are partitions (more only where a partition holds very many groups).
    """
    from boskage.functions.geometry import hull, read_wkb, write_wkb

    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", hull binary"

    def reduced(part: pd.DataFrame) -> list[dict]:
        rows = []
        for key, own in part.groupby(keys, dropna=False, sort=False):
            parts = [p[0] for w in own.hull for p in read_wkb(w)[1]]
            key = key if isinstance(key, tuple) else (key,)
            rows.append({**dict(zip(keys, key)), "hull": write_wkb([[hull(np.vstack(parts))]]) if parts else None})
        return rows

    def within(batches):
        held: list[dict] = []
        for batch in batches:
            held = reduced(pd.concat([pd.DataFrame(held, columns=batch.columns, dtype=object), batch.astype(object)]))
            if len(held) > 20_000:
                yield pd.DataFrame(held, columns=batch.columns)
                held = []
        if held:
            yield pd.DataFrame(held)

    src = df.select(*keys, F.col(geometry).alias("hull"))
    partial = src.mapInPandas(within, schema)
    return partial.groupBy(*keys).applyInPandas(lambda part: pd.DataFrame(reduced(part.astype(object)), columns=[*keys, "hull"]), schema)
