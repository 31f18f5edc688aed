"""All pairs of locations within a radius, by Voronoi cells and vantage-point trees.

Rows are first reduced to distinct locations, so a place that holds a third of all rows is
one location.  Pivots are a sample of the locations, in proportion to them up to a bound, and
at most one in every square of twice the radius, so cells don't get smaller than what a query
has to look at.  Pivots are held in two levels: a location belongs to the nearest pivot of the
group of its nearest top pivot.  For a query q and a set of pivots of which the nearest lies
at d0, a partner within r can only be in cells whose pivot p has d(q, p) <= d0 + 2r (triangle
inequality, at either level), and only where d(q, p) <= r + the distance of the cell's
farthest location; q is copied to just those.  Each cell builds a vantage-point tree of its
own locations and answers its queries in blocks.  A cell with more locations or queries than a
task should hold has them divided by hash; since such a cell is about as small as the radius,
its queries have partners in every part, so the copies stay in proportion to the pairs.
Pairs of locations are then joined back to the rows of both sides by equality.

The metric is the plane's (``plane``, coordinates in metres) or the sphere's
(``great_circle``, longitude and latitude in degrees, radius in metres).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boskage.functions.wkt import locations
from boskage.session import bounded_rows, stable

EARTH = 6371008.8
LEAF = 48


def distance(metric: str, x1, y1, x2, y2) -> np.ndarray:
    if metric == "plane":
        return np.hypot(x1 - x2, y1 - y2)
    if metric != "great_circle":
        raise ValueError(f"unknown metric {metric}")
    a1, a2, d = np.radians(y1), np.radians(y2), np.radians(x1 - x2)
    h = np.sin((a1 - a2) / 2) ** 2 + np.cos(a1) * np.cos(a2) * np.sin(d / 2) ** 2
    return 2 * EARTH * np.arcsin(np.sqrt(np.clip(h, 0, 1)))


class VantageTree:
    """A vantage-point tree over points; queries go down it in blocks."""

    def __init__(self, x: np.ndarray, y: np.ndarray, metric: str = "plane") -> None:
        self.x, self.y, self.metric = x, y, metric
        self.root = self._build(np.arange(len(x)))

    def _build(self, at: np.ndarray):
        if len(at) <= LEAF:
            return at
        # the point farthest from the first makes a good vantage point
        d = distance(self.metric, self.x[at], self.y[at], self.x[at[0]], self.y[at[0]])
        v = at[int(d.argmax())]
        d = distance(self.metric, self.x[at], self.y[at], self.x[v], self.y[v])
        mu = float(np.median(d))
        near = d <= mu
        if near.all():
            near = d < mu
            if not near.any():  # all at one distance: no vantage point divides them
                half = len(at) // 2
                return v, 0.0, float(d.max()), 0.0, float(d.max()), self._build(at[:half]), self._build(at[half:])
        inner, outer = d[near], d[~near]
        return v, inner.min(), inner.max(), outer.min(), outer.max(), self._build(at[near]), self._build(at[~near])

    def within(self, qx: np.ndarray, qy: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """Places of queries and of points at most ``radius`` apart."""
        qs, ps, stack = [], [], [(self.root, np.arange(len(qx)))] if len(self.x) else []
        while stack:
            node, q = stack.pop()
            if len(q) == 0:
                continue
            if isinstance(node, np.ndarray):
                for block in np.array_split(q, max(1, len(q) * len(node) // 2_000_000)):
                    d = distance(self.metric, qx[block][:, None], qy[block][:, None], self.x[node], self.y[node])
                    i, j = np.nonzero(d <= radius)
                    qs.append(block[i])
                    ps.append(node[j])
                continue
            v, low1, high1, low2, high2, near, far = node
            d = distance(self.metric, qx[q], qy[q], self.x[v], self.y[v])
            slack = radius + 1e-6
            stack.append((near, q[(d >= low1 - slack) & (d <= high1 + slack)]))
            stack.append((far, q[(d >= low2 - slack) & (d <= high2 + slack)]))
        return (np.concatenate(qs), np.concatenate(ps)) if qs else (np.zeros(0, int), np.zeros(0, int))


class Pivots:
    """Pivots in two levels: tops, and the pivots nearest to each of them."""

    #: Up to this many pivots one level serves.
    FEW = 64

    def __init__(self, x: np.ndarray, y: np.ndarray, metric: str, apart: float = 0.0) -> None:
        self.metric = metric
        if apart > 0 and len(x):
            # no more than one pivot in a square (on the sphere a cube) of that width
            if metric == "plane":
                at = np.column_stack([x, y])
            else:
                lon, lat = np.radians(x), np.radians(y)
                at = EARTH * np.column_stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)])
            _, first = np.unique(np.floor(at / apart).astype(np.int64), axis=0, return_index=True)
            x, y = x[np.sort(first)], y[np.sort(first)]
        tops = len(x) if len(x) <= self.FEW else int(np.ceil(np.sqrt(len(x))))
        self.tx, self.ty = x[:tops], y[:tops]
        group = np.arange(tops) if tops == len(x) else self._nearest(x, y, self.tx, self.ty)[0]
        order = np.argsort(group, kind="stable")
        self.x, self.y = x[order], y[order]
        self.start = np.searchsorted(group[order], np.arange(tops + 1))

    def _blocks(self, n: int, m: int) -> Iterator[slice]:
        step = max(1, 2_000_000 // max(1, m))
        return (slice(a, a + step) for a in range(0, n, step))

    def _nearest(self, x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, far = np.zeros(len(x), np.int64), np.zeros(len(x))
        for own in self._blocks(len(x), len(px)):
            d = distance(self.metric, x[own, None], y[own, None], px, py)
            at[own] = d.argmin(1)
            far[own] = d[np.arange(len(d)), at[own]]
        return at, far

    def _reached(self, x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows, pivots, far = [], [], []
        for own in self._blocks(len(x), len(px)):
            d = distance(self.metric, x[own, None], y[own, None], px, py)
            i, j = np.nonzero(d <= d.min(1)[:, None] + 2 * radius + 1e-6)
            rows.append(i + own.start)
            pivots.append(j)
            far.append(d[i, j])
        empty = np.zeros(0, np.int64)
        return np.concatenate([empty, *rows]), np.concatenate([empty, *pivots]), np.concatenate([np.zeros(0), *far])

    @staticmethod
    def _runs(at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each value with the places where it stands."""
        order = np.argsort(at, kind="stable")
        values, first = np.unique(at[order], return_index=True)
        for v, own in zip(values, np.split(order, first[1:])):
            yield int(v), own

    def homes(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each location and the distance to its pivot."""
        top, far = self._nearest(x, y, self.tx, self.ty)
        if len(self.tx) == len(self.x):
            return top, far
        cell = np.zeros(len(x), np.int64)
        for t, own in self._runs(top):
            low, high = self.start[t], self.start[t + 1]
            cell[own], far[own] = self._nearest(x[own], y[own], self.x[low:high], self.y[low:high])
            cell[own] += low
        return cell, far

    def copies(self, x: np.ndarray, y: np.ndarray, radius: float, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of all cells that may hold a partner; ``reach`` is the distance of each cell's farthest location."""
        rows, cells, far = self._reached(x, y, self.tx, self.ty, radius)
        if len(self.tx) < len(self.x):
            parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            for t, own in self._runs(cells):
                low, high = self.start[t], self.start[t + 1]
                if low == high:  # a top on the place of another has no group
                    continue
                i, j, d = self._reached(x[rows[own]], y[rows[own]], self.x[low:high], self.y[low:high], radius)
                parts.append((rows[own][i], j + low, d))
            rows, cells, far = (np.concatenate(p) for p in zip(*parts))
        keep = far <= reach[cells] + radius + 1e-6
        return rows[keep], cells[keep]


def near_locations(left: DataFrame, right: DataFrame, radius: float, metric: str = "plane", pivots: int = 262_144, part: int = 20_000, cell: int = 500) -> DataFrame:
    """Pairs (ax, ay, bx, by) of distinct locations of two frames with columns x, y.

    ``cell`` is the number of locations a cell should have, ``pivots`` bounds the sample that
    the cells are made of (fitted once, sent to all executors with two numbers for each), and
    ``part`` is the number of locations or queries from which a cell is divided.  None drops
    anything.  Empty sides give no pair.
    """
    spark = left.sparkSession
    sides = left.select("x", "y", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(right.select("x", "y", F.lit(0).alias("a"), F.lit(1).alias("b")))
    places = stable(sides.groupBy("x", "y").agg(F.max("a").alias("a"), F.max("b").alias("b")))
    n = places.count()
    share = min(pivots, -(-n // cell)) / max(n, 1)
    sample = bounded_rows(places.where(F.pmod(F.xxhash64("x", "y"), F.lit(1 << 40)) < int(share * (1 << 40))).select("x", "y"), 2 * pivots + 1000, "the sample of pivots")
    sample = sample or places.select("x", "y").limit(1).collect()
    if not sample:
        return spark.createDataFrame([], "ax double, ay double, bx double, by double")
    net = Pivots(np.array([r.x for r in sample]), np.array([r.y for r in sample]), metric, 2 * radius)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, far = net.homes(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int32()), pa.array(far)], names=[*batch.schema.names, "cell", "far"])

    at_home = places.mapInArrow(home, "x double, y double, a int, b int, cell int, far double")
    # one row for each cell, so at most as many as pivots
    sizes = at_home.groupBy("cell").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.max(F.when(F.col("a") == 1, F.col("far"))).alias("reach")).toPandas()
    reach = np.full(len(net.x), -np.inf)
    reach[sizes.cell] = np.where(sizes.a > 0, sizes.reach.astype(float), -np.inf)

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            rows, cells = net.copies(x, y, radius, reach)
            yield pa.RecordBatch.from_arrays([pa.array(x[rows]), pa.array(y[rows]), pa.array(cells, pa.int32())], names=["x", "y", "cell"])

    homes = at_home.where("a = 1").select("x", "y", "cell")
    copies = places.where("b = 1").select("x", "y").mapInArrow(copy, "x double, y double, cell int")
    homes, copies = (_divided(side, sizes, part, own) for side, own in ((homes, "part"), (copies, "slice")))

    def join(own: pa.Table, asked: pa.Table) -> pa.Table:
        x, y, qx, qy = (t.column(c).to_numpy() for t in (own, asked) for c in ("x", "y"))
        q, p = VantageTree(x, y, metric).within(qx, qy, radius)
        return pa.table({"ax": x[p], "ay": y[p], "bx": qx[q], "by": qy[q]})

    # coordinates are few bytes but the work on them isn't little, so tasks follow the places and not the bytes
    tasks = max(1, min(-(-n // 2_000), max(spark.sparkContext.defaultParallelism, -(-n // 50_000))))
    keys = ("cell", "part", "slice")
    grouped = (side.repartition(tasks, *keys).groupBy(*keys) for side in (homes, copies))
    return next(grouped).cogroup(next(grouped)).applyInArrow(join, "ax double, ay double, bx double, by double")


def _divided(side: DataFrame, sizes, most: int, own: str) -> DataFrame:
    """A side with the part and slice of each row: its ``own`` by hash, and all of the other.

    Cells with more than ``most`` locations have several parts, those with more queries several
    slices; at most as many cells are listed as there are pivots.
    """
    large = sizes[(sizes.a > most) | (sizes.b > most)]
    rows = [(int(c), int(-(-a // most)), int(-(-b // most))) for c, a, b in zip(large.cell, large.a, large.b)]
    if not rows:
        return side.withColumns({"part": F.lit(0), "slice": F.lit(0)})
    listed = side.sparkSession.createDataFrame(rows, "cell int, parts int, slices int")
    on = side.join(F.broadcast(listed), "cell", "left")
    count = {k: F.greatest(F.lit(1), F.coalesce(f"{k}s", F.lit(1))) for k in ("part", "slice")}
    h = F.pmod(F.xxhash64("x", "y", F.lit(7)), count[own]).cast("int")
    other = "slice" if own == "part" else "part"
    return on.withColumns({own: h, other: F.explode(F.sequence(F.lit(0), count[other] - 1))}).select("x", "y", "cell", "part", "slice")


def located(df: DataFrame, key: str, geometry: str, side: str) -> DataFrame:
    """(row, side, x, y) of the rows whose WKT geometry has a location; EPSG:4326 is brought to EPSG:2154."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = locations(batch.column(1).to_pylist())
            keep = np.flatnonzero(~np.isnan(x))
            own = batch.take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(2), pa.array(x[keep] + 0.0), pa.array(y[keep] + 0.0)], names=["row", "side", "x", "y"])

    kind = df.schema[key].dataType.simpleString()
    src = df.select(F.col(key), F.col(geometry), F.col(side).cast("string")).where(F.col(geometry).isNotNull())
    return src.mapInArrow(run, f"row {kind}, side string, x double, y double")


def near_rows(left: DataFrame, right: DataFrame, radius: float, metric: str = "plane", **how) -> DataFrame:
    """Pairs (a, b) of rows of two frames (row, x, y) whose locations are at most ``radius`` apart.

    Rows that share a place all count; a null row id is kept as such.
    """
    pairs = near_locations(left, right, radius, metric, **how)
    a = left.select(F.col("row").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = right.select(F.col("row").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return pairs.join(a, ["ax", "ay"]).join(b, ["bx", "by"]).select("a", "b")
