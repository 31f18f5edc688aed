"""Graphs as edge tables: building, connected components, communities and their quality."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boskage.config import EDGE_WEIGHTS
from boskage.session import stable


def build(pairs: DataFrame, weight: str = "weight") -> DataFrame:
    """Undirected edges src < dst, each once, with the greatest weight; loops and null ends are dropped."""
    a, b = F.least("src", "dst"), F.greatest("src", "dst")
    clean = pairs.where("src is not null and dst is not null and src != dst").select(a.alias("src"), b.alias("dst"), F.col(weight).alias("weight"))
    return clean.groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def weight_of(mode: str) -> Column:
    """Weight of an edge with attributes ws, wt, we, wc; a missing attribute counts 0."""
    weights = EDGE_WEIGHTS[mode]
    if weights is None:
        return F.lit(1.0)
    parts = [F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in zip(("ws", "wt", "we", "wc"), weights) if w]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total / float(sum(weights))


def smallest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices of some edges, ascending, and the smallest vertex each is connected to: hooking and pointer jumping."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, parent = flat[: len(a)], flat[len(a) :], np.arange(len(ids))
    while True:
        x, y = parent[a], parent[b]
        far = x != y
        if not far.any():
            return ids, ids[parent]
        np.minimum.at(parent, np.maximum(x, y)[far], np.minimum(x, y)[far])
        while (parent[parent] != parent).any():
            parent = parent[parent]


#: Edges that are gathered before a partition's are reduced, and up to which one task finishes a graph.
FEW_EDGES = 1_000_000


def _stars(edges: DataFrame) -> DataFrame:
    """(a, b), a > b: the edges of each partition, reduced to stars around its smallest vertices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros((2, 0), np.int64)]

        def reduce() -> None:
            ids, low = smallest(*np.hstack(held))
            own = ids != low
            held[:] = [np.vstack([ids[own], low[own]])]

        for batch in batches:
            held.append(np.vstack([c.to_numpy() for c in batch.columns]))
            if sum(h.shape[1] for h in held[1:]) >= FEW_EDGES:
                reduce()
        reduce()
        (a, b), step = held[0], 100_000
        for k in range(0, len(a), step):
            yield pa.RecordBatch.from_arrays([pa.array(a[k : k + step]), pa.array(b[k : k + step])], names=["a", "b"])

    return edges.mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(uid, component): the smallest vertex each vertex is connected to.

    Every partition first reduces its edges to stars.  What is left is finished by one task
    where it is small, else by large-star and small-star steps in turn, which end after a
    logarithmic number of rounds and never gather a neighbourhood in one row: minima are
    aggregated before the shuffle.  Nothing is broadcast, so no round is gathered on the
    driver.  Each round is written to the checkpoint folder; the loop ends when no edge
    changes.  Edges with a null end are left out.  Vertices of a type other
    than bigint are reduced by the steps alone.
    """
    e = edges.where("src != dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b"))
    if all(f.dataType.simpleString() in ("bigint", "int") for f in e.schema):
        e = stable(_stars(e.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))))
        if e.count() <= FEW_EDGES:
            return _labelled(stable(_stars(e.coalesce(1))), vertices)
        e = e.distinct()
    else:
        e = stable(e.distinct())
    summary = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    state, new = None, summary(e)
    while new != state:
        state = new
        # large star: every larger neighbour of u is tied to the smallest vertex around u
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        # small star: u and its smaller neighbours are tied to the smallest of them
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(low2.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        e = stable(tied.unionByName(low2.select("a", F.col("m").alias("b"))).distinct())
        new = summary(e)
    return _labelled(e, vertices)


def _labelled(stars: DataFrame, vertices: DataFrame | None) -> DataFrame:
    labels = stars.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "uid")
    roots = labels.select(F.col("component").alias("uid"), "component").distinct()
    labels = labels.unionByName(roots)
    if vertices is not None:
        labels = vertices.select("uid").distinct().join(labels.hint("merge"), "uid", "left").select("uid", F.coalesce("component", "uid").alias("component"))
    return labels


def louvain_kernel(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray, resolution: float, total: float) -> np.ndarray:
    """Community of each vertex 0..n-1; vertices are visited in order, so results repeat.

    ``total`` is the weight of all edges of the whole graph: a community never leaves its
    component, so components may be worked on apart with the graph's total.  Edges of a
    vertex to itself are weight within it.
    """
    member = np.arange(n)
    loops = np.zeros(n)
    own_loop = src == dst
    np.add.at(loops, src[own_loop], w[own_loop])
    src, dst, w = src[~own_loop], dst[~own_loop], w[~own_loop]
    while True:
        around: list[dict[int, float]] = [{} for _ in range(n)]
        for a, b, x in zip(src.tolist(), dst.tolist(), w.tolist()):
            around[a][b] = around[a].get(b, 0.0) + x
            around[b][a] = around[b].get(a, 0.0) + x
        degree = np.array([sum(d.values()) for d in around]) + 2 * loops
        own, volume, moved = list(range(n)), degree.copy(), False
        for _ in range(100):
            changed = 0
            for v in range(n):
                links: dict[int, float] = {}
                for u, x in around[v].items():
                    links[own[u]] = links.get(own[u], 0.0) + x
                home = own[v]
                volume[home] -= degree[v]
                best, gain = home, links.get(home, 0.0) - resolution * degree[v] * volume[home] / (2 * total)
                for c in sorted(links):
                    g = links[c] - resolution * degree[v] * volume[c] / (2 * total)
                    if g > gain + 1e-12:
                        best, gain = c, g
                volume[best] += degree[v]
                if best != home:
                    own[v], changed = best, changed + 1
            moved |= changed > 0
            if changed == 0:
                break
        if not moved:
            return member
        names, own_ids = np.unique(own, return_inverse=True)
        member = own_ids[member]
        if len(names) == n:  # nothing was merged, so another pass would weigh the same graph
            return member
        inner = own_ids[src] == own_ids[dst]
        new_loops = np.zeros(len(names))
        np.add.at(new_loops, own_ids, loops)
        np.add.at(new_loops, own_ids[src[inner]], w[inner])
        loops, n = new_loops, len(names)
        src, dst, w = own_ids[src[~inner]], own_ids[dst[~inner]], w[~inner]


def parallel_moves(edges: DataFrame, resolution: float, least_gain: float = 1e-4) -> DataFrame:
    """(uid, community) after rounds in which all vertices weigh moving at once.

    In each round a vertex may move to the neighbouring community of greatest gain; which
    half of the vertices may move is drawn by a hash, so that neighbours don't swap for ever.
    The rounds go on until nothing moves in two of them, or four have raised the modularity by
    less than ``least_gain``; the best state seen is given.  Links are aggregated per vertex
    and community before they are compared; no vertex's neighbourhood and no community is
    gathered in one row.  ``total`` of an edge is the weight of the whole graph it belongs to.
    """
    ends = edges.where("src != dst")
    both = stable(ends.select(F.col("src").alias("u"), F.col("dst").alias("v"), "weight", "total").unionByName(ends.select(F.col("dst").alias("u"), F.col("src").alias("v"), "weight", "total")))
    loops = edges.where("src = dst").select(F.col("src").alias("u"), (2 * F.col("weight")).alias("weight"), "total")
    degrees = both.select("u", "weight", "total").unionByName(loops).groupBy("u").agg(F.sum("weight").alias("k"), F.max("total").alias("total"))
    state = stable(degrees.select("u", F.col("u").alias("c"), "k", "total"))
    both = both.drop("total")
    kept, history, still, r = state, [], 0, 0
    while True:
        volume = state.groupBy("c").agg(F.sum("k").alias("volume"))
        links = both.join(state.select(F.col("u").alias("v"), "c"), "v").groupBy("u", "c").agg(F.sum("weight").alias("w"))
        own = state.select("u", F.col("c").alias("home"), "k", "total")
        at_home = own.select("u", F.col("home").alias("c"), F.lit(0.0).alias("w"))
        options = links.unionByName(at_home).groupBy("u", "c").agg(F.sum("w").alias("w")).join(own, "u").join(volume, "c")
        here = F.col("c") == F.col("home")
        gain = F.col("w") - resolution * F.col("k") * (F.col("volume") - F.when(here, F.col("k")).otherwise(0.0)) / (2 * F.col("total"))
        best = options.withColumn("gain", gain).groupBy("u", "home", "k", "total").agg(
            F.max(F.struct("gain", (-F.col("c")).alias("c"))).alias("best"), F.max(F.when(here, F.col("gain"))).alias("stay"),
            F.max(F.when(here, F.col("w"))).alias("inner"), F.max(F.when(here, F.col("volume"))).alias("volume"),
        )
        go = (F.col("best.gain") > F.col("stay") + 1e-12) & (F.pmod(F.xxhash64("u", F.lit(r)), F.lit(2)) == 0)
        new = stable(best.select("u", F.when(go, -F.col("best.c")).otherwise(F.col("home")).alias("c"), "k", "total", go.alias("moved"), "inner", "volume"))
        # the modularity before the moves, but for the loops, which no move changes
        at = new.agg(F.sum(F.col("moved").cast("long")), F.sum(F.col("inner") / (2 * F.col("total")) - resolution * F.col("k") * F.col("volume") / (4 * F.pow("total", F.lit(2))))).first()
        if not history or at[1] > max(history):
            kept = state
        history.append(at[1] or 0.0)
        still = still + 1 if not at[0] else 0
        if still == 2 or (len(history) > 4 and max(history) - max(history[:-4]) < least_gain):
            return kept.select(F.col("u").alias("uid"), F.col("c").alias("community"))
        state, r = new.select("u", "c", "k", "total"), r + 1


def contract(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """The graph of communities; weight inside a community becomes its edge to itself."""
    a = membership.select(F.col("uid").alias("src"), F.col("community").alias("a"))
    b = membership.select(F.col("uid").alias("dst"), F.col("community").alias("b"))
    on = edges.join(a, "src").join(b, "dst")
    return on.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.sum("weight").alias("weight"), F.max("total").alias("total"))


def louvain(edges: DataFrame, vertices: DataFrame | None = None, resolution: float = 1.0, most_edges: int = 200_000) -> DataFrame:
    """(uid, community): the smallest member names the community; vertices without edges are their own.

    A component of up to ``most_edges`` edges is solved in one task.  Larger ones are first
    worked on by ``parallel_moves`` and contracted, level by level, each to its end, until they
    are that small; where no level merges anything any more, the communities found stand.
    Edges may have a column ``total``, the weight of the whole graph they belong to, where
    several graphs without common vertices are solved together.
    """
    e = edges.select("src", "dst", F.col("weight").cast("double").alias("weight"), *(c for c in ("total",) if c in edges.columns))
    if "total" not in edges.columns:
        e = stable(e)
        e = e.withColumn("total", F.lit(float(e.agg(F.sum("weight")).first()[0] or 1.0)))
    e = stable(e)
    tasks = max(e.sparkSession.sparkContext.defaultParallelism, -(-e.count() // 100_000))

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        ids, flat = np.unique(np.concatenate([part.src, part.dst]), return_inverse=True)
        order = np.lexsort((part.dst, part.src))
        m = len(part)
        found = louvain_kernel(len(ids), flat[:m][order], flat[m:][order], part.weight.to_numpy()[order], resolution, float(part.total.iloc[0]))
        low = pd.Series(ids).groupby(found).transform("min")
        return pd.DataFrame({"uid": ids, "community": low.to_numpy()})

    def by_component(graph: DataFrame, labels: DataFrame) -> DataFrame:
        parts = graph.join(labels, graph.src == labels.uid).select("component", "src", "dst", "weight", "total")
        # edges are few bytes but the work on them isn't little, so tasks don't follow the bytes
        return parts.repartition(tasks, "component").groupBy("component").applyInPandas(solve, "uid bigint, community bigint")

    labels = stable(components(e))
    sizes = e.join(labels, e.src == labels.uid).groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > most_edges)
    large = stable(sizes.select("component"))  # at most as many rows as edges over most_edges
    if large.isEmpty():
        found = by_component(e, labels)
    else:
        inside = labels.join(F.broadcast(large), "component", "left_semi")
        found = by_component(e.join(inside, e.src == inside.uid, "left_anti"), labels)
        graph = stable(e.join(inside, e.src == inside.uid, "left_semi"))
        place = inside.select("uid", F.col("uid").alias("community"))
        size = graph.select(F.explode(F.array("src", "dst"))).distinct().count()
        while True:
            moves = parallel_moves(graph, resolution)
            graph = stable(contract(graph, moves))
            place = stable(place.join(moves.select(F.col("uid").alias("community"), F.col("community").alias("next")), "community").select("uid", F.col("next").alias("community")))
            new = graph.select(F.explode(F.array("src", "dst"))).distinct().count()
            if graph.count() <= most_edges or new == size:
                break
            size = new
        if graph.count() <= most_edges:
            top = components(graph, graph.select(F.explode(F.array("src", "dst")).alias("uid")))
            last = by_component(graph, top).select(F.col("uid").alias("community"), F.col("community").alias("next"))
            place = place.join(last, "community").select("uid", F.col("next").alias("community"))
        low = place.groupBy("community").agg(F.min("uid").alias("low"))
        found = found.unionByName(place.join(low, "community").select("uid", F.col("low").alias("community")))
    if vertices is not None:
        found = vertices.select("uid").distinct().join(found, "uid", "left").select("uid", F.coalesce("community", "uid").alias("community"))
    return found


def modularity(edges: DataFrame, membership: DataFrame, resolution: float = 1.0, label: str = "community") -> DataFrame:
    """One row: the modularity of a partition."""
    m = membership
    e = edges.join(m.select(F.col("uid").alias("src"), F.col(label).alias("ca")), "src").join(m.select(F.col("uid").alias("dst"), F.col(label).alias("cb")), "dst")
    inner = e.groupBy(F.col("ca").alias("c")).agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0)).alias("w"))
    ends = e.select(F.col("ca").alias("c"), "weight").unionByName(e.select(F.col("cb").alias("c"), "weight")).groupBy("c").agg(F.sum("weight").alias("d"))
    total = edges.agg(F.sum("weight").alias("m"))
    joined = ends.join(inner, "c", "left").join(F.broadcast(total))
    return joined.agg(F.sum(F.coalesce("w", F.lit(0.0)) / F.col("m") - resolution * F.pow(F.col("d") / (2 * F.col("m")), 2)).alias("modularity"))


def isolated(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    seen = edges.select(F.explode(F.array("src", "dst")).alias("uid"))
    return vertices.join(seen, "uid", "left_anti")
