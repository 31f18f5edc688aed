"""Filling containers of fixed capacity with items that may not be split.

Best-two-fit: a container is filled greedily with the largest unpacked item that still fits.
Then its smallest item is weighed against two unpacked ones: if two items fit the gap that
the smallest would leave more tightly than it does, they take its place and it returns to the
unpacked ones; this is repeated while it fills the container further.

Only sizes are packed: items are counted by size, so one step costs the number of different
sizes and not of items, and item ids are dealt out to the sizes afterwards.  Items are divided
into shards by a hash of their id; a shard packs on its own, so any number of items is packed
in parallel, and each shard leaves about one container with much room.  An item larger than
the capacity is the only one that is split: full containers, and a rest packed like an item.

Defined cases: null texts aren't items; an empty text is one token long; items of size zero
or less are errors of the caller; ties are resolved by id; an item as large as the capacity
fills a container alone; capacities must be positive; empty tables give no row.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boskage.session import bounded_rows

#: Items that a shard packs on average.
SHARD_ITEMS = 20_000
MOST_CONTAINERS = 1_000


def byte_tokens(text: str) -> Column:
    """Tokens of the byte-level tokenizer ByT5: one per UTF-8 byte and one end token."""
    return F.octet_length(F.col(text)) + F.lit(1)


class Shelf:
    """Unpacked items, counted by size."""

    def __init__(self, sizes: np.ndarray, capacity: int) -> None:
        self.count = np.bincount(sizes, minlength=capacity + 1)
        self.kinds = np.flatnonzero(self.count)  # sizes that may be left, ascending; emptied ones are dropped now and then
        self.left, self.gone = int(self.count.sum()), 0

    def take(self, size: int) -> None:
        self.count[size] -= 1
        self.left -= 1
        if self.count[size] == 0:
            self.gone += 1
            if self.gone * 4 > len(self.kinds):
                self.kinds, self.gone = self.kinds[self.count[self.kinds] > 0], 0

    def put(self, size: int) -> None:
        if self.count[size] == 0:
            at = np.searchsorted(self.kinds, size)
            if at < len(self.kinds) and self.kinds[at] == size:
                self.gone -= 1
            else:
                self.kinds = np.insert(self.kinds, at, size)
        self.count[size] += 1
        self.left += 1

    def largest(self, room: int) -> int:
        """The largest size within the room, 0 if there is none."""
        at = int(np.searchsorted(self.kinds, room, "right")) - 1
        while at >= 0 and self.count[self.kinds[at]] == 0:
            at -= 1
        return int(self.kinds[at]) if at >= 0 else 0

    def two(self, room: int) -> tuple[int, int]:
        """Two items of the greatest sum within the room; sum 0 if there are none."""
        small = self.kinds[: int(np.searchsorted(self.kinds, room // 2, "right"))]
        small = small[self.count[small] > 0]
        if len(small) == 0:
            return 0, 0
        # the tightest partner of each candidate for the smaller item
        full = self.kinds if self.gone == 0 else self.kinds[self.count[self.kinds] > 0]
        at = np.searchsorted(full, room - small, "right") - 1
        partner = full[at]
        single = (partner == small) & (self.count[small] < 2)
        at = np.where(single, at - 1, at)
        ok = (at >= 0) & (full[at] >= 1)
        total = np.where(ok, small + full[np.maximum(at, 0)], 0)
        best = int(total.argmax())
        return (int(small[best]), int(full[at[best]])) if total[best] else (0, 0)


def best_two_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Containers as lists of sizes; every size is at most the capacity."""
    shelf, containers = Shelf(np.asarray(sizes, np.int64), capacity), []
    while shelf.left:
        own: list[int] = []  # a heap, the smallest first
        room = capacity
        while room and (size := shelf.largest(room)):
            shelf.take(size)
            heapq.heappush(own, size)
            room -= size
        while room and shelf.left and own:  # every replacement leaves less room
            small = own[0]
            a, b = shelf.two(room + small)
            if a + b <= small:
                break
            heapq.heapreplace(own, a)
            heapq.heappush(own, b)
            shelf.take(a)
            shelf.take(b)
            shelf.put(small)
            room += small - a - b
        containers.append(own)
    return containers


def pack(items: DataFrame, containers: DataFrame, item: str, size: str, container: str = "container_id", capacity: str = "capacity", shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(container, item, bin_id, part, n_parts, tokens): where every piece of every item lies, for each kind of container.

    ``bin_id`` is unique within a kind of container.  Only items larger than the capacity have
    several parts.
    """
    kinds = containers.select(F.col(container).alias("c"), F.col(capacity).cast("long").alias("cap")).where("c is not null and cap > 0").distinct()
    kc, ki = containers.schema[container].dataType.simpleString(), items.schema[item].dataType.simpleString()
    listed = [F.struct(F.lit(r["c"]).cast(kc).alias("c"), F.lit(r["cap"]).cast("long").alias("cap")) for r in bounded_rows(kinds, MOST_CONTAINERS, "the kinds of container")]
    if not listed:
        listed = [F.struct(F.lit(None).cast(kc).alias("c"), F.lit(None).cast("long").alias("cap"))]
    # the number of items is read from the files' footers where the table comes straight from files
    shards = max(1, -(-items.select(item).count() // shard_items))
    sized = items.select(F.col(item).alias("i"), F.col(size).cast("long").alias("n")).where("n is not null and i is not null")
    sharded = sized.withColumn("shard", F.pmod(F.xxhash64("i", F.lit(5)), F.lit(shards)).cast("int"))
    spread = sharded.withColumn("kind", F.explode(F.array(*listed))).select("i", "n", "shard", "kind.c", "kind.cap").where("c is not null")

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        cap = int(frame.cap.iloc[0])
        frame = frame.sort_values(["n", "i"], kind="stable").reset_index(drop=True)
        n, ids, shard = frame.n.to_numpy(), frame.i.to_numpy(), int(frame.shard.iloc[0])
        parts = np.maximum(1, -(-n // cap))
        # full containers of split items first, each on its own
        whole = parts - 1
        split_at = np.repeat(np.arange(len(n)), whole)
        first = np.concatenate([[0], np.cumsum(whole)])
        part_of = np.arange(len(split_at)) - first[split_at] + 1
        rest = n - whole * cap
        bins = best_two_fit(rest, cap)
        # deal the items of each size out to the containers in order
        order = np.lexsort((np.arange(len(rest)), rest))
        starts = np.searchsorted(rest[order], np.arange(cap + 2))
        used, at, where = starts[:-1].copy(), [], []
        for b, own in enumerate(bins):
            for s in own:
                at.append(order[used[s]])
                used[s] += 1
                where.append(b)
        at, where = np.array(at, np.int64), np.array(where, np.int64)
        base = (shard << 32) + len(split_at)
        return pd.DataFrame({
            container: frame.c.iloc[0],
            item: np.concatenate([ids[split_at], ids[at]]),
            "bin_id": np.concatenate([(shard << 32) + np.arange(len(split_at)), base + where]),
            "part": np.concatenate([part_of, parts[at]]).astype(np.int32),
            "n_parts": np.concatenate([parts[split_at], parts[at]]).astype(np.int32),
            "tokens": np.concatenate([np.full(len(split_at), cap), rest[at]]),
        })

    out = f"`{container}` {kc}, `{item}` {ki}, bin_id bigint, part int, n_parts int, tokens bigint"
    # sizes are few bytes but packing isn't little work, so tasks follow the shards: a few for each task, at least two for each core
    packs = shards * len(listed)
    tasks = min(packs, max(2 * items.sparkSession.sparkContext.defaultParallelism, -(-packs // 8)))
    return spread.repartition(max(tasks, 1), "c", "shard").groupBy("c", "shard").applyInPandas(fill, out)


def bin_check(packed: DataFrame, containers: DataFrame, container: str = "container_id", capacity: str = "capacity", item: str = "doc_id") -> DataFrame:
    """(container, items, tokens, overfull, torn): what the containers hold together, those over capacity, and items split though they would fit."""
    caps = F.broadcast(containers.select(F.col(container).alias("k"), F.col(capacity).cast("long").alias("cap")).distinct())
    bins = packed.groupBy(container, "bin_id").agg(F.sum("tokens").alias("t"), F.sum((F.col("part") == 1).cast("long")).alias("i"))
    filled = bins.join(caps, F.col(container) == F.col("k")).groupBy(container).agg(F.sum("i").alias("items"), F.sum("t").alias("tokens"), F.sum((F.col("t") > F.col("cap")).cast("long")).alias("overfull"))
    whole = packed.groupBy(container, item).agg(F.sum("tokens").alias("t"), F.max("n_parts").alias("p"))
    torn = whole.join(caps, F.col(container) == F.col("k")).groupBy(F.col(container).alias("k2")).agg(F.sum(((F.col("p") > 1) & (F.col("t") <= F.col("cap"))).cast("long")).alias("torn"))
    return filled.join(torn, F.col(container) == F.col("k2")).select(container, "items", "tokens", "overfull", "torn")


def fill_report(packed: DataFrame, containers: DataFrame, container: str = "container_id", capacity: str = "capacity") -> DataFrame:
    """(container, bins, tokens, fill): containers used, tokens in them, and the share of their room that is filled."""
    own = packed.groupBy(container).agg(F.countDistinct("bin_id").alias("bins"), F.sum("tokens").alias("tokens"))
    return own.join(F.broadcast(containers.select(container, capacity)), container).select(
        container, "bins", "tokens", F.round(F.col("tokens") / (F.col("bins") * F.col(capacity)), 6).alias("fill")
    )
