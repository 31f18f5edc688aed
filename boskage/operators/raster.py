"""Rasters as tables of pixels (raster_id, row, col, value)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boskage.functions.planar import pixel_to_world
from boskage.operators.graph import components


def masked(pixels: DataFrame, keep: Column) -> DataFrame:
    return pixels.where(F.col("value").isNotNull() & keep)


def wrapped_difference(a: Column, b: Column) -> Column:
    """a - b as 16-bit integers wrap it."""
    return F.pmod(a.cast("int") - b.cast("int") + 32768, F.lit(65536)) - 32768


def clear_cut(before: DataFrame, after: DataFrame) -> DataFrame:
    """(row, col, cut): whether the canopy (centimetres) fell from high to at most 5 m by at least 5 m."""
    pair = before.select("row", "col", F.col("value").alias("h1")).join(after.select("row", "col", F.col("value").alias("h2")), ["row", "col"])
    drop = wrapped_difference(F.col("h1"), F.col("h2"))
    return pair.select("row", "col", ((F.col("h2") <= 500) & drop.between(500, 27767)).alias("cut"))


def height_drop(before: Column, after: Column) -> Column:
    """Class of a loss of height in metres: 0 below 8, then up to 10, up to 20, above."""
    d = before - after
    return F.when(d < 8, 0).when(d < 10, 1).when(d <= 20, 2).otherwise(3)


def consecutive(rasters: DataFrame, raster: str = "raster_id") -> DataFrame:
    """(a, b): each raster and the next in order."""
    ids = rasters.select(F.col(raster).alias("a")).distinct()  # as many rows as rasters
    return ids.withColumn("b", F.lead("a").over(Window.orderBy("a"))).where("b is not null")


def drought_recovery(frames: DataFrame, last: int, window: int, high: int = 4, low: int = 3, n: int = 5, m: int = 5) -> DataFrame:
    """(row, col, recovered): at least n frames of ``high`` or more in the window up to ``last``, and at least m of ``low`` before it."""
    recent = F.col("frame").between(last - window + 1, last)
    return frames.where(F.col("frame") <= last).groupBy("row", "col").agg(
        ((F.sum((recent & (F.col("value") >= high)).cast("int")) >= n) & (F.sum((~recent & (F.col("value") == low)).cast("int")) >= m)).alias("recovered")
    )


def evaluation_windows(n_frames: int, interval: int = 36, lead_in: int = 18) -> list[tuple[int, int]]:
    """(start, end) of the sliding windows of a series: a step of one interval, looking back one interval."""
    return [(k - interval, k) for k in range(interval + lead_in, n_frames - interval, interval)]


def windowed(frames: DataFrame, windows: list[tuple[int, int]], condition: Column, least: int) -> DataFrame:
    """(window, row, col): pixels with at least ``least`` frames of a window that meet a condition."""
    spark = frames.sparkSession
    w = F.broadcast(spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(windows)], "window int, a int, b int"))
    hit = frames.where(condition).join(w, (F.col("frame") >= w.a) & (F.col("frame") < w.b))
    return hit.groupBy("window", "row", "col").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def downsample(pixels: DataFrame, factor: int = 3) -> DataFrame:
    cell = lambda c: F.floor(F.col(c) / factor).cast("int").alias(c)
    return pixels.groupBy(cell("row"), cell("col")).agg(F.avg("value").alias("value"))


def cropped(pixels: DataFrame, row0: int, row1: int, col0: int, col1: int, nodata: int | None = None) -> DataFrame:
    inside = pixels.where(F.col("row").between(row0, row1) & F.col("col").between(col0, col1))
    return inside if nodata is None else inside.withColumn("value", F.when(F.col("value") != nodata, F.col("value")))


def regions(pixels: DataFrame, width: int) -> DataFrame:
    """(row, col, value, region): 4-connected regions of equal value; a region is named by its first pixel in reading order."""
    p = pixels.where("value is not null").select("row", "col", "value", (F.col("row").cast("long") * width + F.col("col")).alias("uid"))
    right = p.select(F.col("row"), (F.col("col") - 1).alias("col"), "value", F.col("uid").alias("dst"))
    below = p.select((F.col("row") - 1).alias("row"), F.col("col"), "value", F.col("uid").alias("dst"))
    edges = p.join(right.unionByName(below), ["row", "col", "value"]).select(F.col("uid").alias("src"), "dst")
    return p.join(components(edges), "uid", "left").select("row", "col", "value", F.coalesce("component", "uid").alias("region"))


def region_shapes(labelled: DataFrame, affine: tuple[float, ...]) -> DataFrame:
    """One row per region: value, pixels, area, centre and box in world coordinates."""
    x, y = pixel_to_world(F.col("row") + 0.5, F.col("col") + 0.5, affine)
    pixel = abs(affine[0] * affine[4] - affine[1] * affine[3])
    hx, hy = (abs(affine[0]) + abs(affine[1])) / 2, (abs(affine[3]) + abs(affine[4])) / 2
    on = labelled.withColumns({"x": x, "y": y})
    return on.groupBy("region", "value").agg(
        F.count("*").alias("pixels"), (F.count("*") * pixel).alias("area"), F.avg("x").alias("cx"), F.avg("y").alias("cy"),
        (F.min("x") - hx).alias("minx"), (F.min("y") - hy).alias("miny"), (F.max("x") + hx).alias("maxx"), (F.max("y") + hy).alias("maxy"),
    )


def region_outlines(labelled: DataFrame, affine: tuple[float, ...]) -> DataFrame:
    """(region, value, geometry): the polygon of each region in WKB, holes included.

    Only the sides of pixels that border another region or none are gathered, so a task holds
    a region's outline and not its pixels.
    """
    from boskage.functions import geometry

    near = labelled.select("row", "col", F.col("region").alias("other"))
    # each side of a pixel with the inside on its left, in columns and rows
    sides = ((-1, 0, (1, 0, 0, 0)), (1, 0, (0, 1, 1, 1)), (0, -1, (0, 0, 0, 1)), (0, 1, (1, 1, 1, 0)))
    around = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc"), *(F.lit(v).alias(n) for v, n in zip(at, ("x1", "y1", "x2", "y2")))) for dr, dc, at in sides])
    on = labelled.select("row", "col", "value", "region", F.explode(around).alias("s"))
    beside = on.select((F.col("row") + F.col("s.dr")).alias("row"), (F.col("col") + F.col("s.dc")).alias("col"), "region", "value", *(
        (F.col("col" if n[0] == "x" else "row") + F.col(f"s.{n}")).cast("double").alias(n) for n in ("x1", "y1", "x2", "y2")
    ))
    edges = beside.join(near, ["row", "col"], "left").where("other is null or other != region").select("region", "value", "x1", "y1", "x2", "y2")
    a, b, c, d, e, f = affine
    flip = a * e - b * d > 0

    def trace(part: pd.DataFrame) -> pd.DataFrame:
        xy = part[["x1", "y1", "x2", "y2"]].to_numpy(float)
        parts = geometry._rings(xy[:, [2, 3, 0, 1]])
        made = []
        for rings in parts:
            own = []
            for r in rings:
                turn = np.roll(r, -1, 0) - r
                corner = (np.roll(turn, 1, 0) != turn).any(1)
                r = r[corner]
                world = np.column_stack([a * r[:, 0] + b * r[:, 1] + c, d * r[:, 0] + e * r[:, 1] + f])
                own.append(world if flip else world[::-1])
            made.append(own)
        wkb = geometry.write_wkb(made, geometry.POLYGON if len(made) == 1 else geometry.MULTIPOLYGON)
        return pd.DataFrame({"region": part.region.iloc[:1], "value": part.value.iloc[:1], "geometry": [wkb]})

    kind = labelled.schema["value"].dataType.simpleString()
    return edges.groupBy("region", "value").applyInPandas(trace, f"region bigint, value {kind}, geometry binary")
