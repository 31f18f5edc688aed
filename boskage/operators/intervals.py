"""Continuous periods and gaps of the intervals of each entity.

The intervals are first reduced to one per entity and start (the latest end wins), which
bounds a hot entity by its distinct starts, then sorted globally by (entity, start) with a
range partitioning that may cut an entity anywhere, and written once to the checkpoint
folder.  A first scan gives one summary per partition: its last entity, the greatest end of
that entity's rows there, the start of its last period and whether the partition holds only
that entity.  The summaries (as many as partitions, whatever the data) are prefix-combined,
and a second scan carries the state that precedes its partition: it labels each period with
its start, gives the piece of the period it saw, and a gap wherever a period begins after
another of the same entity.  Pieces with one label are merged by a last aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boskage.session import stable

LOWEST = np.iinfo(np.int64).min


def _runs(entity: np.ndarray) -> np.ndarray:
    """Where a new entity begins in a sorted column."""
    new = np.ones(len(entity), bool)
    new[1:] = entity[1:] != entity[:-1]
    return new


def _before(entity: np.ndarray, end: np.ndarray, carry: tuple | None) -> np.ndarray:
    """For each row, the greatest end of the earlier rows of its entity; LOWEST if there are none."""
    new = _runs(entity)
    group = np.cumsum(new) - 1
    if len(end) == 0:
        return end
    # a running maximum that restarts: each entity is lifted above all that precede it
    low, span = int(end.min()), int(end.max()) - int(end.min()) + 1
    first = LOWEST
    if carry and carry[0] == entity[0]:
        first = carry[1]
        low, span = min(low, first), max(int(end.max()), first) - min(low, first) + 1
    lifted = (end - low) + group * span
    start = np.empty_like(lifted)
    start[1:] = lifted[:-1]
    start[0] = first - low if first != LOWEST else 0
    before = np.maximum.accumulate(start) - group * span + low
    before[new] = LOWEST
    if first != LOWEST:
        before[0] = first
    return before


def merge_days(df: DataFrame, entity: str, start: str, end: str, at_least: int = 1) -> DataFrame:
    """Periods and gaps of intervals given as day numbers (both days belong to the interval).

    ``entity`` is an integer column, ``start`` and ``end`` are days since 1970.  Gives
    (entity, kind, first_day, last_day) with kind ``period`` or ``gap``; days that follow one
    another are one period.  Rows with a null in one of the three or an end before the start
    are no intervals; entities with fewer than ``at_least`` intervals (repeated rows count)
    give nothing.  Empty tables give no row.
    """
    out = f"`{entity}` bigint, kind string, first_day int, last_day int"
    src = df.select(
        F.col(entity).cast("long").alias("e"), F.col(start).cast("int").alias("s"), F.col(end).cast("int").alias("t")
    ).where("e is not null and s is not null and t is not null and t >= s")
    once = src.groupBy("e", "s").agg(F.max("t").alias("t"), F.count("*").alias("n"))
    ordered = stable(once.repartitionByRange("e", "s").sortWithinPartitions("e", "s"))

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, carry, island, only = False, None, None, True
        for batch in batches:
            if batch.num_rows == 0:
                continue
            e, s, t = (batch.column(i).to_numpy().astype(np.int64) for i in range(3))
            before = _before(e, t, carry)
            opens = (before == LOWEST) | (s > before + 1)
            only &= e[0] == e[-1] and (not seen or carry[0] == e[-1])
            if opens.any():
                island = int(s[np.flatnonzero(opens)[-1]])
            carry, seen = (int(e[-1]), int(max(t[-1], before[-1]))), True
        if seen:
            row = [[TaskContext.get().partitionId()], [carry[0]], [carry[1]], [island], [only]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()))],
                names=["p", "e", "t", "i", "only"],
            )

    summaries = sorted(ordered.select("e", "s", "t").mapInArrow(summarise, "p int, e bigint, t bigint, i bigint, only boolean").collect())
    carries: dict[int, tuple] = {}
    state: tuple | None = None
    for p, e, t, i, only in summaries:
        if state:
            carries[p] = state
        if state and only and state[0] == e:  # the entity goes through the whole partition
            # the summary saw the partition alone: its last period began before it if the carried end reaches it
            state = (e, max(t, state[1]), state[2] if state[1] + 1 >= i else i)
        else:
            state = (e, t, i)

    def rescan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = carries.get(TaskContext.get().partitionId())
        for batch in batches:
            if batch.num_rows == 0:
                continue
            e, s, t = (batch.column(i).to_numpy().astype(np.int64) for i in range(3))
            before = _before(e, t, carry)
            opens = (before == LOWEST) | (s > before + 1)
            at = np.flatnonzero(opens)
            label = np.full(len(e), carry[2] if carry else 0, np.int64)
            if len(at):
                label[at[0] :] = np.repeat(s[at], np.diff(np.append(at, len(e))))
            # one piece for each label in the batch
            cuts = at if len(at) and at[0] == 0 else np.insert(at, 0, 0)
            reach = np.maximum.reduceat(np.maximum(t, np.where(opens, LOWEST, before)), cuts)
            gap = np.flatnonzero(opens & (before != LOWEST))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([e[cuts], e[gap]])),
                    pa.array(["period"] * len(cuts) + ["gap"] * len(gap), pa.string()),
                    pa.array(np.concatenate([label[cuts], before[gap] + 1]).astype(np.int32)),
                    pa.array(np.concatenate([reach, s[gap] - 1]).astype(np.int32)),
                ],
                names=[entity, "kind", "first_day", "last_day"],
            )
            carry = (int(e[-1]), int(max(t[-1], before[-1])), int(label[-1]))

    days = ordered.select("e", "s", "t")
    pieces = days.mapInArrow(rescan, out)
    if at_least > 1:  # counted on what was written, so the source is read once
        enough = ordered.groupBy(F.col("e").alias(entity)).agg(F.sum("n").alias("n")).where(F.col("n") >= at_least)
        pieces = pieces.join(enough, entity, "left_semi")
    return pieces.groupBy(entity, "kind", "first_day").agg(F.max("last_day").alias("last_day"))


def exact_day(column: str) -> F.Column:
    """Days since 1970 of a text that is an existing day written exactly ``yyyy-mm-dd``, else null."""
    c = F.col(column)
    day = F.when(c.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & ~c.startswith("0000"), F.expr(f"try_cast(`{column}` as date)"))
    return F.unix_date(day)


def periods_and_gaps(df: DataFrame, entity: str, start: str, end: str, at_least: int = 2) -> DataFrame:
    """``merge_days`` over columns of day texts; days come out as ``yyyy-mm-dd``."""
    days = df.select(F.col(entity), exact_day(start).alias("s_"), exact_day(end).alias("t_"))
    text = lambda c: F.date_format(F.date_from_unix_date(c), "yyyy-MM-dd").alias(c)
    return merge_days(days, entity, "s_", "t_", at_least).select(entity, "kind", text("first_day"), text("last_day"))


def periods_by_window(df: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """The same periods by a window over each entity, for small entities and as a cross-check in tests."""
    w = Window.partitionBy(entity).orderBy(start, end)
    marked = df.where(f"`{entity}` is not null and `{end}` >= `{start}`").withColumn(
        "reach", F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    )
    marked = marked.withColumn("new", F.coalesce((F.col(start) > F.col("reach") + 1).cast("int"), F.lit(0)))
    return (
        marked.withColumn("island", F.sum("new").over(w))
        .groupBy(entity, "island")
        .agg(F.min(start).alias("first_day"), F.max(end).alias("last_day"))
        .drop("island")
    )
