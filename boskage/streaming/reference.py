"""Streams of events against a fixed reference table.

The grid join is stateless on the stream's side, so it runs on a stream as it does on a
table: each event meets the reference polygons near it as it arrives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boskage.operators.spatial_join import BOX, within_distance


def anchor(stream: DataFrame, reference: DataFrame, radius: float, key: str = "uid") -> DataFrame:
    """(key, ts, index_reference, sd) of each arriving event and every reference within ``radius``.

    ``stream`` has key, ts and a box; ``reference`` index_reference and a box.
    """
    found = within_distance(stream.select(key, "ts", *BOX), reference.select("index_reference", *BOX), radius)
    return found.select(F.col(f"l_{key}").alias(key), F.col("l_ts").alias("ts"), F.col("r_index_reference").alias("index_reference"), "sd")


def anchored_counts(stream: DataFrame, reference: DataFrame, radius: float, window: str = "1 day", late: str = "2 days", key: str = "uid") -> DataFrame:
    """Events per reference and time window; events later than ``late`` are left out once their window is closed."""
    on = anchor(stream, reference, radius, key).withWatermark("ts", late)
    return on.groupBy(F.window("ts", window), "index_reference").agg(F.count("*").alias("n"), F.min("sd").alias("nearest"))
