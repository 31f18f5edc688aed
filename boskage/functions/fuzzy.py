"""Token-set similarity of short names, computed once per distinct pair of names."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            keep = row[j]
            row[j] = last + 1 if x == y else max(row[j], row[j - 1])
            last = keep
    return row[-1]


def indel_ratio(a: str, b: str) -> float:
    return 100.0 * 2 * common(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_set_ratio(a: str | None, b: str | None) -> int:
    """0 to 100: the best agreement of the words two names share and those they don't; empty names agree with nothing."""
    ta, tb = (set(re.sub(r"[\W_]+", " ", (s or "").lower()).split()) for s in (a, b))
    if not ta or not tb:
        return 0
    both, only_a, only_b = (" ".join(sorted(s)) for s in (ta & tb, ta - tb, tb - ta))
    if both and (not only_a or not only_b):
        return 100
    with_a, with_b = (f"{both} {s}".strip() for s in (only_a, only_b))
    scores = [indel_ratio(with_a, with_b)] + ([indel_ratio(both, with_a), indel_ratio(both, with_b)] if both else [])
    return round(max(scores))


def name_pairs(names: DataFrame, column: str, most: int = 5_000) -> DataFrame:
    """(a, b, ratio) of every ordered pair of distinct names, for a bounded list of names."""
    distinct = names.select(F.col(column).alias("a")).where("a is not null").distinct()
    if distinct.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} distinct names")

    @F.pandas_udf("int")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([token_set_ratio(x, y) for x, y in zip(a, b)], dtype="int32")

    # a stated list of names against itself, bounded above
    return distinct.join(F.broadcast(distinct.withColumnRenamed("a", "b")), F.lit(True)).withColumn("ratio", ratio("a", "b"))
