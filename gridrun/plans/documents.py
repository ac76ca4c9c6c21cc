"""Export layers, marker tables, text cards and survey documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridrun.constants import (BUILTUP, ROAD, ROOFTOP_MAX_ASPECT, ROOFTOP_MAX_PX, ROOFTOP_MIN_FILL, ROOFTOP_MIN_PX, WATER)
from gridrun.functions.scoring import accessibility_score, rnd
from gridrun.operators.components import aspect, component_stats, fill, label_components
from gridrun.operators.polygons import boundary_measures, large_enough, polygons
from gridrun.plans.visits import top_priorities

# Export layers: fixed values (class, smallest area in pixels).
LAYERS = {"roads": (ROAD, 200), "building_footprints": (BUILTUP, 100), "water_bodies": (WATER, 500)}
MARKER_COLORS = ["255,60,60", "255,140,60", "255,220,80", "180,220,100", "120,200,120"]


def layer_binaries(mask: DataFrame, labelled: DataFrame) -> DataFrame:
    """Runs per export layer: rooftop-shaped components for buildings, else the class."""
    roofs = component_stats(labelled.filter(F.col("class_id") == BUILTUP)).filter(
        F.col("area_px").between(ROOFTOP_MIN_PX, ROOFTOP_MAX_PX) & (aspect() <= ROOFTOP_MAX_ASPECT) & (fill() >= ROOFTOP_MIN_FILL))
    cols = ["raster_id", "row", "c0", "c1", "class_id"]
    bu = labelled.filter(F.col("class_id") == BUILTUP).join(roofs.select("raster_id", "comp_id"), ["raster_id", "comp_id"], "left_semi").select(*cols)
    rest = mask.filter(F.col("class_id").isin(ROAD, WATER)).select(*cols)
    name = reduce(lambda c, kv: c.when(F.col("class_id") == kv[1][0], kv[0]), LAYERS.items(), F.when(F.lit(False), ""))
    return bu.unionByName(rest).withColumn("layer", name)


def _footprints(mask: DataFrame, labelled: DataFrame, frame) -> DataFrame:
    """All export layers labelled 4-connected in one pass; their classes never overlap."""
    return label_components(layer_binaries(mask, labelled), frame, connectivity=4)


def _named(df: DataFrame) -> DataFrame:
    name = F.coalesce(*[F.when(F.col("class_id") == k, n) for n, (k, _) in LAYERS.items()])
    return df.withColumn("layer", name)


MIN_PX = {k: px for k, px in LAYERS.values()}


def layer_table(mask: DataFrame, labelled: DataFrame, gsd: float, frame) -> DataFrame:
    """One row per 4-connected footprint above its layer's size: area and perimeter."""
    m = large_enough(boundary_measures(_footprints(mask, labelled, frame), gsd), MIN_PX)
    return _named(m).select("layer", "class_id", "raster_id", "comp_id", "area_px", "area_m2", "perimeter_m")


def layer_polygons(mask: DataFrame, labelled: DataFrame, catalog: DataFrame, gsd: float, frame) -> DataFrame:
    """The same rows with simplified world rings."""
    return _named(polygons(_footprints(mask, labelled, frame), catalog, gsd, MIN_PX))


def markers(queue: DataFrame, width: int, height: int, n: int = 5) -> DataFrame:
    """Clipped pixel position and colour of the first ``n`` queue items."""
    at = lambda c, size: F.least(F.greatest(F.floor(c), F.lit(0)), F.lit(size - 1)).cast("int")
    color = F.element_at(F.array(*[F.lit(c) for c in MARKER_COLORS]), F.least(F.col("rank"), F.lit(len(MARKER_COLORS))).cast("int"))
    return queue.filter(F.col("rank") <= n).select("raster_id", "rank", at("centroid_x_px", width).alias("x_px"), at("centroid_y_px", height).alias("y_px"), color.alias("color"))


def survey_documents(village: DataFrame, spatial: DataFrame, explain: DataFrame, queue: DataFrame, catalog: DataFrame) -> DataFrame:
    """Nested document per raster; every side has one row per raster, the queue at most ten."""
    q = queue.groupBy("raster_id").agg(F.sort_array(F.collect_list(F.struct("rank", *[c for c in queue.columns if c not in ("rank", "raster_id")]))).alias("queue"))
    top = top_priorities(queue, catalog).groupBy("raster_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]).alias("top"))
    pack = lambda df, name: df.select("raster_id", F.struct(*[c for c in df.columns if c != "raster_id"]).alias(name))
    d = (pack(village, "infrastructure").join(pack(spatial.withColumn("accessibility", rnd(accessibility_score(), 1)), "spatial"), "raster_id")
         .join(pack(explain, "explainability"), "raster_id").join(q, "raster_id", "left").join(top, "raster_id"))
    num = lambda c, n=0: F.format_number(c, n)
    i, s, e = "infrastructure.", "spatial.", "explainability."
    facts = F.array(
        F.concat(F.lit("Total survey area: "), F.format_string("%.2f", F.col(i + "total_area_ha")), F.lit(" ha")),
        F.concat(F.lit("Road network: ~"), num(F.col(i + "road_length_m")), F.lit(" m across "), F.col(s + "road_connected_components").cast("string"), F.lit(" segment(s)")),
        F.concat(F.lit("Built-up: "), F.col(i + "n_buildings").cast("string"), F.lit(" structures; "), num(F.col(s + "builtup_road_access_pct")), F.lit("% within road access buffer")),
        F.concat(F.lit("Water: "), F.col(i + "n_water_bodies").cast("string"), F.lit(" bodies covering "), num(F.col(i + "water_area_m2")), F.lit(" m²")),
        F.concat(F.lit("Automated confidence: "), num(F.col(e + "high_confidence_pct")), F.lit("% high-confidence; "), num(F.col(e + "review_required_pct")), F.lit("% flagged for review")))
    head = F.array(F.concat(F.lit("Village Accessibility Score: "), num(F.col(s + "accessibility")), F.lit("/100")))
    return d.withColumn("queue", F.coalesce("queue", F.array().cast(dict(q.dtypes)["queue"]))).withColumn(
        "executive_summary", F.concat(head, F.slice("top", 1, 3), facts, F.slice(F.col(s + "recommendations"), 1, 2)))


def summary_cards(village: DataFrame, bridges: DataFrame) -> DataFrame:
    """Plain-text card per raster with at most five bridge lines."""
    from gridrun.operators.ranking import top_k
    five = top_k(bridges, ["raster_id"], ["comp_id"], 5).groupBy("raster_id").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("rank", "x_px", "y_px", "area_m2"))),
        lambda b: F.concat(F.lit("      Bridge "), b["rank"].cast("string"), F.lit(": ("), b["x_px"].cast("string"), F.lit(", "), b["y_px"].cast("string"), F.lit(") ~"), F.format_number(b["area_m2"], 0), F.lit(" m2"))), "\n").alias("bridge_lines"))
    d = village.join(five, "raster_id", "left")
    sep = "=" * 60
    n = lambda c, k=0: F.format_number(F.col(c), k)
    line = lambda label, *parts: F.concat(F.lit(label), *parts)
    lines = [F.lit(sep), F.lit("  VILLAGE SURVEY REPORT"), line("  Village: ", F.col("raster_id").cast("string")), F.lit(sep),
             line("  Total Area: ", n("total_area_ha", 2), F.lit(" ha ("), n("total_area_m2"), F.lit(" m2)")),
             F.lit("  ROAD NETWORK"), line("    Total length:   ~", n("road_length_m"), F.lit(" m")), line("    Coverage:        ", n("road_coverage_pct", 1), F.lit("% of area")),
             line("    Road segments:   ", F.col("road_segments").cast("string")),
             F.lit("  BUILT-UP AREA"), line("    Area:            ", n("builtup_area_m2"), F.lit(" m2 ("), n("builtup_coverage_pct", 1), F.lit("%)")),
             line("    Buildings:       ", F.col("n_buildings").cast("string")), line("    Probable rooftops: ", F.col("rooftop_count").cast("string")),
             line("    Density:         ", n("building_density_per_ha", 1), F.lit(" buildings/ha")),
             F.lit("  WATER BODIES"), line("    Total area:      ", n("water_area_m2"), F.lit(" m2 ("), n("water_coverage_pct", 1), F.lit("%)")),
             line("    Water bodies:    ", F.col("n_water_bodies").cast("string")),
             F.lit("  BRIDGES"), line("    Detected:        ", F.col("n_bridges").cast("string")), line("    Total area:      ", n("bridge_area_m2"), F.lit(" m2")), F.col("bridge_lines"),
             line("    Automated coverage: ", n("confidence_coverage_pct", 1), F.lit("% high-confidence")), F.lit(sep)]
    return d.select("raster_id", F.concat_ws("\n", *lines).alias("card"))
