"""From raw inventories and rasters to event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boskage.functions import planar
from boskage.operators import raster
from boskage.operators.relational import case_of, first_per
from boskage.operators.spatial_join import enrich
from boskage.plans import vocabulary as v


def lookup(values: dict, key: Column) -> Column:
    """A value by key, null where there is none."""
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def bare(text: Column) -> Column:
    """A text without its characters beyond ASCII: accents, whole, lost or wrongly decoded, compare as equal."""
    return F.regexp_replace(text, "[^ -~]", "")


def bare_lookup(values: dict[str, str], key: Column) -> Column:
    return lookup({"".join(c for c in k if " " <= c <= "~"): x for k, x in values.items()}, bare(key))


def report_class(problem: Column, kind: Column) -> Column:
    """Class of a health report; the order of the tests matters, and blanks are part of the words looked for."""
    low = F.lower(problem)
    return case_of([(low.contains("sécheresse"), "Drought-dieback"), (low.contains("feu "), "Fire"), (low.contains("vent "), "Storm"), (kind.isin(*v.BIOTIC_TYPES), "Biotic")], "Other")


def split_biotic(cls: Column, severity: Column) -> Column:
    return F.when(cls == "Biotic", F.when(severity < 4, "Biotic-dieback").otherwise("Biotic-mortality")).otherwise(cls)


def tree_type(name: Column) -> Column:
    """Tree type by the first list that holds any word of the name."""
    words = F.transform(F.split(name, " "), F.initcap)
    out = F.lit(None).cast("string")
    for kind, known in reversed(v.TREE_WORDS.items()):
        out = F.when(F.arrays_overlap(words, F.array(*[F.lit(w[:1].upper() + w[1:].lower()) for w in known])), kind).otherwise(out)
    return out


def process_hm(raw: DataFrame, split: bool = True) -> DataFrame:
    """Health reports: severe ones of known kinds, classed and placed; rows with any null are dropped."""
    kept = raw.where((F.col("Sévérité") > 1) & F.col("LIB_Type de problème").isin(*v.DAMAGE_TYPES))
    cls = report_class(F.col("LIB_Problème principal"), F.col("LIB_Type de problème"))
    x, y = planar.lambert93(F.col("Longitude"), F.col("Latitude"))
    return kept.select(
        F.col("Année d'observation").cast("int").alias("year"), x.alias("cx"), y.alias("cy"), F.col("LIB_Problème principal").alias("cause"), F.col("Remarques").alias("notes"),
        F.col("Sévérité").alias("severity"), (split_biotic(cls, F.col("Sévérité")) if split else cls).alias("class"),
        lookup(v.REPORT_SPECIES, F.col("`LIB_Essence regroupée (ess. concernée)`")).alias("essence"), lookup(v.REPORT_TREES, F.col("`LIB_Feuillus/Résineux (ess. concernée)`")).alias("tree_type"),
        F.lit("hm").alias("dataset"),
    ).dropna()


def process_firepolygons(inventory: DataFrame, polygons: DataFrame) -> DataFrame:
    """Fire outlines joined to their inventory rows by UID; only fires that have an outline."""
    own = inventory.join(polygons.select("UID", "geometry"), "UID")
    named = own.withColumnsRenamed({"annee": "year", "date_de_premiere_alerte": "start_date", "surface_foret_m2": "forest_area_m2", "nom_de_la_commune": "name", "type_de_peuplement": "essence"})
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("nan"))
    return named.withColumn("uuid", F.concat_ws("_", *(text(c) for c in ("year", "code_insee", "name", "start_date", "numero")))).select(
        "uuid", "year", "start_date", "forest_area_m2", "essence", "name", "geometry"
    )


def process_senfseidl(cause: DataFrame, year: DataFrame, affine: tuple[float, ...], width: int, nodata: int = 65535) -> DataFrame:
    """Regions of equal year where a cause is known; the cause is that of the pixel under the region's centre."""
    mask = cause.where("value > 0").select("row", "col")
    pixels = year.where(F.col("value").isNotNull() & (F.col("value") != nodata)).join(mask, ["row", "col"])
    shapes = raster.region_shapes(raster.regions(pixels, width), affine)
    row, col = planar.world_to_pixel(F.col("cx"), F.col("cy"), affine)
    at = shapes.withColumns({"row": row, "col": col}).join(cause.select("row", "col", F.col("value").alias("cause")), ["row", "col"], "left")
    return at.select("region", F.col("value").cast("int").alias("year"), lookup(v.RASTER_CAUSES, F.col("cause").cast("int")).alias("class"), "area", "cx", "cy", "minx", "miny", "maxx", "maxy", F.lit("senfseidl").alias("dataset"))


def process_forms(rasters: DataFrame, affine: tuple[float, ...], width: int) -> DataFrame:
    """Clear-cuts between consecutive height rasters (year, row, col, value in centimetres), as regions of one season."""
    pairs = raster.consecutive(rasters, "year").withColumnsRenamed({"a": "y1", "b": "y2"})
    old = rasters.join(F.broadcast(pairs), rasters.year == pairs.y1).select("y1", "y2", "row", "col", F.col("value").alias("h1"))
    both = old.join(rasters.select(F.col("year").alias("y2"), "row", "col", F.col("value").alias("h2")), ["y2", "row", "col"])
    drop = raster.wrapped_difference(F.col("h1"), F.col("h2"))
    cut = both.where((F.col("h2") <= 500) & drop.between(500, 27767))
    # one raster below the other, so that one labelling serves all seasons
    rows = rasters.agg((F.max("row") - F.min("row") + 2).alias("rows")).first()["rows"] or 1
    stacked = cut.select((F.col("row") + F.col("y1") * F.lit(rows)).alias("row"), "col", (F.col("y1") * 10000 + F.col("y2")).alias("value"))
    labelled = raster.regions(stacked, width)
    back = labelled.withColumn("row", F.col("row") - F.expr("value div 10000") * F.lit(rows))
    shapes = raster.region_shapes(back, affine)
    y1, y2 = F.expr("value div 10000").cast("int"), (F.col("value") % 10000).cast("int")
    return shapes.select(
        "region", "area", "cx", "cy", "minx", "miny", "maxx", "maxy", F.make_date(y1, F.lit(9), F.lit(1)).alias("start_date"), F.make_date(y2, F.lit(5), F.lit(1)).alias("end_date"),
        F.lit("clear-cut").alias("class"), F.lit("forms").alias("dataset"), y1.alias("year"),
    )


def process_cdi(frames: DataFrame, affine: tuple[float, ...], width: int, least: int = 7) -> DataFrame:
    """Regions of equal drought value in each dated frame (frame_date, row, col, value)."""
    alert = frames.where(F.col("value") >= least)
    day = F.unix_date("frame_date")
    rows = frames.agg((F.max("row") - F.min("row") + 2).alias("rows")).first()["rows"] or 1
    stacked = alert.select((F.col("row") + day.cast("long") * F.lit(rows)).alias("row"), "col", (day * 1000 + F.col("value")).alias("value"))
    labelled = raster.regions(stacked, width)
    back = labelled.withColumn("row", F.col("row") - F.expr("value div 1000") * F.lit(rows))
    date = F.date_from_unix_date(F.expr("value div 1000").cast("int"))
    return raster.region_shapes(back, affine).select(
        "region", "area", "cx", "cy", "minx", "miny", "maxx", "maxy", date.alias("start_date"), date.alias("end_date"), F.lit("drought").alias("class"), F.lit("cdi").alias("dataset"), F.year(date).alias("year")
    )


def drought_maps(frames: DataFrame, n_frames: int, interval: int = 36, n: int = 5, m: int = 5) -> DataFrame:
    """(window, row, col): pixels that partly recovered in a window after alerts in the one before."""
    windows = raster.evaluation_windows(n_frames, interval)
    late = raster.windowed(frames, [(b, b + interval) for _, b in windows], F.col("value") >= 4, n)
    early = raster.windowed(frames, windows, F.col("value") == 3, m)
    return late.select("window", "row", "col").join(early.select("window", "row", "col"), ["window", "row", "col"])


def process_bdforet(raw: DataFrame) -> DataFrame:
    """Forest map: species in English whatever the encoding of the source, and their tree type."""
    named = raw.withColumn("essence", F.lower(bare_lookup(v.FOREST_TYPES, F.col("ESSENCE"))))
    return named.withColumn("tree_type", tree_type(F.col("essence")))


def process_dfde(raw: DataFrame, causes: dict[str, list[str]]) -> DataFrame:
    """Historical records: class by list of causes, species in English, tree type; repeated records once."""
    cls = case_of([(F.col("cause").isin(*names), c) for c, names in causes.items() if names], "Other")
    tree = case_of([(F.col("species").isin(*names), t) for t, names in v.RECORD_TREES.items()], None)
    own = raw.withColumns({"class": cls, "tree_type": tree, "essence": F.coalesce(lookup(v.RECORD_SPECIES, F.col("species")), F.col("species"))})
    return own.dropDuplicates(["name", "start_date", "end_date", "essence", "cause", "notes"])


def process_bdiff(fires: DataFrame, forest: DataFrame, least_m2: float = 5000.0) -> DataFrame:
    """Large fires with the species of the forest they meet; outlines that occur twice once, those marked to be kept first."""
    own = fires.where(F.col("forest_area_m2") > least_m2)
    if "keep" in own.columns:
        own = first_per(own, ["uuid"], [F.desc("keep"), "year"])
    found = enrich(own, forest, "uuid", 0.0, drop=("nr", "none"))
    return own.drop("essence", "tree_type").join(found.drop("hits"), "uuid").withColumns({"class": F.lit("Fire"), "dataset": F.lit("bdiff")})


def _hits(rules: dict[str, tuple[str, ...]]) -> Column:
    out = F.lit(0)
    for column, codes in rules.items():
        out = out + F.when(F.col(column).cast("string").isin(*codes), 1).otherwise(0)
    return out


def _answered(rules: dict) -> Column:
    out = F.lit(0)
    for column in rules:
        out = out + F.col(column).isNotNull().cast("int")
    return out


def inventory_scores() -> dict[str, Column]:
    """Score of each class: hits over answers, strong ones thrice; nothing answered counts as a thousand answers."""
    scores = {}
    for c in v.STRONG:
        most = 3 * _answered(v.STRONG[c]) + _answered(v.WEAK[c])
        scores[c] = (3 * _hits(v.STRONG[c]) + _hits(v.WEAK[c])) / F.when(most > 0, most).otherwise(1000)
    return scores


def classify_inventory(plots: DataFrame) -> DataFrame:
    """Plots with class, probability and intensity by scores; ties go to the class declared first, no hit gives no class."""
    scores = inventory_scores()
    top = F.greatest(*scores.values())
    cls = case_of([(score == top, c) for c, score in scores.items()], None)
    return plots.withColumns({"probability": top, "class": F.when(top > 0, cls), "intensity": F.col("INCID")})


def classify_inventory_by_incident(plots: DataFrame) -> DataFrame:
    """Plots with class by the kind of incident alone, and dates from the death of trees or the campaign."""
    n = F.col("NINCID").cast("int")
    logged = F.col("DC").cast("string").isin(*"123456789") | (F.col("PRELEV5").cast("string") == "2")
    cls = F.when(n == 1, "Fire").when(n == 2, "Mortality").when(n.isin(3, 4), "Storm").when((n == 0) & logged, "Anthropogenic").otherwise("Other")
    y, dead = F.col("CAMPAGNE").cast("int"), F.col("DATEMORT").cast("int")
    start = F.when(dead == 1, F.make_date(y - 5, F.lit(1), F.lit(1)))
    end = F.when(dead == 1, F.make_date(y, F.lit(12), F.lit(28))).when(dead == 2, F.make_date(y - 5, F.lit(12), F.lit(28))).when(dead.isNull(), F.make_date(y, F.lit(12), F.lit(28)))
    return plots.withColumns({"class": cls, "intensity": F.col("INCID"), "start_date": start, "end_date": end})


def plots_of_trees(plots: DataFrame, trees: DataFrame, *others: DataFrame, values: tuple[str, ...] = ()) -> DataFrame:
    """Plots with the common values of their tall, lit trees (more than a quarter of them agree) and their other tables."""
    from boskage.operators.votes import thresholded_mode

    clean = trees.where((F.col("LIB") > 1) & ((F.col("HTOT") > 5) | F.col("HTOT").isNull()))
    out = plots.join(clean.select("IDP").distinct(), "IDP")
    for other in others:
        out = out.join(other, "IDP")
    for value in values:
        out = out.join(thresholded_mode(clean, "IDP", value).withColumnRenamed("mode", value), "IDP", "left")
    return out


def mean_heights(trees: DataFrame) -> DataFrame:
    return trees.groupBy("IDP").agg(F.avg("HTOT").alias("HTOT"), F.count("*").alias("trees"))


def newest(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_k = 1").drop("_k")
