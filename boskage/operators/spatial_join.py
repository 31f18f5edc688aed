"""Spatial and spatio-temporal joins of rectangles and points on a grid.

Both sides are copied to the cells their rectangles cover and joined by cell; a pair is
given in one cell only, the one that holds the lower left corner of the rectangles'
intersection, so no pair has to be made distinct afterwards.  Where some rectangles are far
larger than a cell, further levels of coarser cells may be asked for: a rectangle is copied to
the finest level where it covers few cells and to the coarser ones, and a pair meets on the
coarser of its two levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boskage.functions import geometry, planar

BOX = ("minx", "miny", "maxx", "maxy")
DAY_US = 86_400_000_000
#: Cells of distance joins are at least that wide.
LEAST_CELL = 500.0


def with_box(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Points as rectangles without extent."""
    return df.withColumns({"minx": F.col(x), "maxx": F.col(x), "miny": F.col(y), "maxy": F.col(y)})


def grow(df: DataFrame, by: Column | float) -> DataFrame:
    return df.withColumns({"minx": F.col("minx") - by, "miny": F.col("miny") - by, "maxx": F.col("maxx") + by, "maxy": F.col("maxy") + by})


#: How much wider the cells of a level are than those of the one below.
WIDER = 16.0


def _on_grid(df: DataFrame, p: str, cell: float, levels: int) -> DataFrame:
    """A side with a row for each cell of each level it is joined on."""
    size = F.greatest(F.col(f"{p}maxx") - F.col(f"{p}minx"), F.col(f"{p}maxy") - F.col(f"{p}miny"))
    if levels > 1:
        level = F.ceil(F.log(WIDER, F.greatest(size / (4 * cell), F.lit(1.0))))
        own = F.least(F.lit(levels - 1), level).cast("int")
        df = df.withColumn(f"{p}level", own).withColumn("level", F.explode(F.sequence(f"{p}level", F.lit(levels - 1))))
    else:
        df = df.withColumns({f"{p}level": F.lit(0), "level": F.lit(0)})
    width = F.lit(cell) * F.pow(F.lit(WIDER), F.col("level"))
    at = lambda c: F.floor(F.col(p + c) / width).cast("long")
    return df.withColumn("cx", F.explode(F.sequence(at("minx"), at("maxx")))).withColumn("cy", F.explode(F.sequence(at("miny"), at("maxy"))))


def meeting(left: DataFrame, right: DataFrame, cell: float, levels: int = 1, days: float | None = None, shuffled: bool = False) -> DataFrame:
    """All pairs whose rectangles meet; columns of the sides come out prefixed ``l_`` and ``r_``.

    Both sides need minx, miny, maxx, maxy.  Rows with a null or NaN there meet nothing.  With
    ``days`` both sides need mid_us, and only pairs whose floored gap is at most that come out:
    time is cut into spans of that length, which are part of the key.  With ``shuffled`` no
    side is sent to the driver to be broadcast, however small it is thought to be: estimates
    of sizes don't know of a row's copies.
    """
    l, r = (df.select(*(F.col(c).alias(p + c) for c in df.columns)) for df, p in ((left, "l_"), (right, "r_")))
    ok = lambda p: " and ".join(f"not isnan({p}{c})" for c in BOX)
    l, r = _on_grid(l.where(ok("l_")), "l_", cell, levels), _on_grid(r.where(ok("r_")), "r_", cell, levels)
    keys = ["level", "cx", "cy"]
    if days is not None:
        # a gap of d days is less than d + 1 of them
        span = F.lit(int((days + 1) * DAY_US))
        at = lambda c: F.floor(F.col(c) / span).cast("int")
        l = l.withColumn("span", F.explode(F.sequence(at("l_mid_us") - 1, at("l_mid_us") + 1)))
        r = r.withColumn("span", at("r_mid_us"))
        keys.append("span")
    a, b = planar.rect("l_"), planar.rect("r_")
    width = F.lit(cell) * F.pow(F.lit(WIDER), F.col("level"))
    once = (F.col("cx") == F.floor(F.greatest(a["minx"], b["minx"]) / width)) & (F.col("cy") == F.floor(F.greatest(a["miny"], b["miny"]) / width))
    if levels > 1:
        once = once & (F.greatest("l_level", "r_level") == F.col("level"))
    if days is not None:
        once = once & (day_gap() <= days)
    return l.join(r.hint("merge") if shuffled else r, keys).where(planar.rects_meet(a, b) & once).drop(*keys, "l_level", "r_level")


def day_gap() -> Column:
    """Days between the middles of both sides, floored before the sign is dropped."""
    return F.abs(F.floor((F.col("l_mid_us") - F.col("r_mid_us")) / F.lit(DAY_US))).cast("long")


def within_distance(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Pairs at most ``radius`` apart, with their distance ``sd``: of geometries in WKB where both sides have them, else of rectangles."""
    pairs = own_boxes(meeting(grow(keep_boxes(left), radius), right, max(radius, LEAST_CELL), 2))
    near = pairs.withColumn("sd", planar.rect_distance(planar.rect("l_"), planar.rect("r_"))).where(F.col("sd") <= radius)
    return near.withColumn("sd", gaps()).where(F.col("sd") <= radius) if "geometry" in left.columns and "geometry" in right.columns else near


def keep_boxes(df: DataFrame) -> DataFrame:
    """A side with copies of its box, which is about to be grown."""
    return df.withColumns({f"_{c}": F.col(c) for c in BOX})


def own_boxes(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns({f"l_{c}": F.col(f"l__{c}") for c in BOX}).drop(*(f"l__{c}" for c in BOX))


def gaps() -> Column:
    """Distance of the geometries of both sides of a pair; a null geometry is the point of its box."""
    return geometry.gap("l_geometry", "l_minx", "l_miny", "r_geometry", "r_minx", "r_miny")


def nearest(left: DataFrame, right: DataFrame, key: str, radius: float) -> DataFrame:
    """For each left row the nearest right rows within ``radius``; rows tied at the least distance all stay."""
    pairs = within_distance(left, right, radius)
    w = Window.partitionBy(f"l_{key}")
    return pairs.withColumn("least", F.min("sd").over(w)).where("sd = least").drop("least")


def candidate_pairs(events: DataFrame, radius: float, most_days: int) -> DataFrame:
    """Pairs uid_a < uid_b where b's rectangle meets the square around a's centre and the floored day gap is small.

    Events need uid, cx, cy, a rectangle and mid_us in microseconds.
    """
    square = keep_boxes(events).withColumns({"minx": F.col("cx") - radius, "maxx": F.col("cx") + radius, "miny": F.col("cy") - radius, "maxy": F.col("cy") + radius})
    pairs = own_boxes(meeting(square, events, radius, days=most_days).where("l_uid < r_uid"))
    return pairs.withColumn("days", day_gap())


def strict_pairs(events: DataFrame, radius: float, most_days: float) -> DataFrame:
    """Undirected pairs whose rectangles, one grown by ``radius``, meet within less than ``most_days``."""
    # of cells twice as wide a grown point covers four instead of nine
    pairs = meeting(grow(events, radius), events, 2 * radius, days=most_days, shuffled=True).where("l_uid < r_uid").withColumn("days", day_gap())
    return pairs.where(F.col("days") < most_days).select(F.col("l_uid").alias("src"), F.col("r_uid").alias("dst"), "days")


def adaptive_pairs(events: DataFrame, radius: float, most_days: float, rounds: int = 3) -> DataFrame:
    """``strict_pairs``; then events still alone look again in twice the radius and time.

    Goes on until the graph is connected, or ``rounds`` rounds are done and no event is alone.
    A single event stays alone; it ends when the radius covers all of them in place and time.
    The events are computed once, and a round looks only at those the last one left alone.
    """
    from boskage.operators.graph import components
    from boskage.session import stable

    events = stable(events)
    uids = events.select("uid").distinct()
    span = events.agg(
        F.greatest(F.max("maxx") - F.min("minx"), F.max("maxy") - F.min("miny")).alias("far"), ((F.max("mid_us") - F.min("mid_us")) / F.lit(DAY_US)).alias("long"), F.count_distinct("uid").alias("n")
    ).first()
    found = edges = stable(strict_pairs(events, radius, most_days))
    alone = events
    k = 1
    while (span["n"] or 0) > 1:
        seen = found.select(F.explode(F.array("src", "dst")).alias("uid")).distinct()
        alone = stable(alone.join(seen.hint("merge"), "uid", "left_anti"))
        n_alone = alone.count()
        if k >= rounds and n_alone == 0:
            break
        if n_alone == 0 and components(edges.select("src", "dst"), uids).select("component").distinct().count() == 1:
            break
        r, t = radius * 2**k, most_days * 2**k
        if r > 2 * (span["far"] or 0) and t > 2 * (span["long"] or 0) + 2 and k >= rounds:
            break  # nothing new can be found
        pairs = meeting(grow(alone, r), events, r, days=t, shuffled=True).where("l_uid != r_uid").withColumn("days", day_gap())
        more = pairs.where(F.col("days") < t).select(F.least("l_uid", "r_uid").alias("src"), F.greatest("l_uid", "r_uid").alias("dst"), "days")
        # both ends may be alone and find each other from either side
        found = stable(more.groupBy("src", "dst").agg(F.min("days").alias("days")))
        edges = edges.unionByName(found)
        k += 1
    return edges


def attach(groups: DataFrame, entities: DataFrame, cell: float, slack_days: int = 0) -> DataFrame:
    """Pairs of a group and a large entity whose rectangles meet while the entity's middle lies in the group's period.

    Groups need start_us and end_us, entities mid_us; an entity may attach to many groups.
    """
    slack = F.lit(slack_days * 86_400_000_000)
    return meeting(groups, entities, cell).where(F.col("r_mid_us").between(F.col("l_start_us") - slack, F.col("l_end_us") + slack))


def enrich(rows: DataFrame, lookup: DataFrame, key: str, buffer: float, drop: tuple[str, ...] = ()) -> DataFrame:
    """Tree type and species of everything within ``buffer`` of a row: none, its own, ``Mixed`` and the distinct species sorted.

    A null tree type counts as a value of its own; ``drop`` lists species that don't count.
    """
    shape = [c for c in (*BOX, "geometry") if c in rows.columns and c in lookup.columns]
    met = within_distance(rows.select(key, *shape), lookup.select(*shape, "tree_type", "essence"), buffer)
    kept = F.when(~F.lower("r_essence").isin(*drop) if drop else F.lit(True), F.col("r_essence"))
    own = met.groupBy(f"l_{key}").agg(
        F.count("*").alias("hits"),
        (F.count_distinct("r_tree_type") + F.max(F.col("r_tree_type").isNull().cast("int"))).alias("kinds"),
        F.max("r_tree_type").alias("one"),
        F.array_join(F.sort_array(F.collect_set(kept)), ",").alias("essence"),
    )
    out = own.select(F.col(f"l_{key}").alias(key), "hits", F.when(F.col("kinds") == 1, F.col("one")).otherwise("Mixed").alias("tree_type"), "essence")
    return rows.select(key).join(out, key, "left").withColumn("hits", F.coalesce("hits", F.lit(0)))


def pixel_lookup(points: DataFrame, pixels: DataFrame, affine: tuple[float, ...], x: str = "cx", y: str = "cy") -> DataFrame:
    """The raster value under each point, null beyond the raster."""
    row, col = planar.world_to_pixel(F.col(x), F.col(y), affine)
    return points.withColumns({"row": row, "col": col}).join(pixels.select("row", "col", "value"), ["row", "col"], "left")


def containing(points: DataFrame, regions: DataFrame, cell: float, levels: int = 2) -> DataFrame:
    """Pairs of a point (columns x, y) and a region (a rectangle and its WKB ``geometry``) that contains it.

    A point on an edge may be inside or not; null and empty geometries contain nothing.
    """
    on = meeting(with_box(points), regions.where("geometry is not null"), cell, levels)
    nothing = F.lit(None).cast("binary")
    return on.where(geometry.gap(nothing, "l_x", "l_y", "r_geometry", F.lit(0.0), F.lit(0.0)) == 0)
