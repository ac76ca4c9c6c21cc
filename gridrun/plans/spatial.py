"""Per-raster spatial intelligence and village reports.

Every report starts from one labelled table and one overlay, aggregates them to
one row per raster, and joins those small tables on the catalog.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridrun.constants import (BRIDGE, BUILTUP, MIN_CLUSTER_PX, MIN_REVIEW_ZONE_PX, ROAD, ROAD_ACCESS_M, ROOFTOP_MAX_ASPECT,
                               ROOFTOP_MAX_PX, ROOFTOP_MIN_FILL, ROOFTOP_MIN_PX, WATER, WATER_PROXIMITY_M)
from gridrun.functions.scoring import pct, recommendations, rnd
from gridrun.operators.components import aspect, component_stats, fill
from gridrun.operators.morphology import dilate, disc, radius_px
from gridrun.operators.proximity import near_pixels
from gridrun.operators.runs import class_layer, run_len
from gridrun.operators.strips import box_layer_of, lay_over

MAX_DILATE_PX = 64      # beyond this radius the tiled nearness test is used


def near_layer(mask: DataFrame, source_class: int, target: DataFrame, metres: float, gsd: float, frame) -> DataFrame:
    """Runs near a class: a dilated layer, or for wide radii the near part of ``target``."""
    r = radius_px(metres, gsd)
    source = class_layer(mask, source_class)
    return dilate(source, disc(r), frame) if r <= MAX_DILATE_PX else near_pixels(target, source, r)


def builtup_nearness(mask: DataFrame, gsd: float, frame) -> DataFrame:
    """Built-up pixels, and how many lie near road and near water, per raster."""
    bu = class_layer(mask, BUILTUP)
    o = lay_over({"b": box_layer_of(bu), "r": box_layer_of(near_layer(mask, ROAD, bu, ROAD_ACCESS_M, gsd, frame)),
                  "w": box_layer_of(near_layer(mask, WATER, bu, WATER_PROXIMITY_M, gsd, frame))}, under="b")
    n = run_len()
    return o.groupBy("raster_id").agg(
        F.sum(n).alias("bu_px"),
        F.coalesce(F.sum(F.when(F.col("r").isNotNull(), n)), F.lit(0)).alias("near_road_px"),
        F.coalesce(F.sum(F.when(F.col("w").isNotNull(), n)), F.lit(0)).alias("near_water_px"))


def component_summary(stats: DataFrame) -> DataFrame:
    """All per-raster component measures in one aggregate over component rows."""
    is_ = lambda k: F.col("class_id") == k
    a = F.col("area_px")
    cnt = lambda cond: F.count_if(cond)
    tot = lambda cond, v=a: F.coalesce(F.sum(F.when(cond, v)), F.lit(0))
    building = is_(BUILTUP) & a.between(50, 50000)
    return stats.groupBy("raster_id").agg(
        tot(is_(ROAD)).alias("road_px"), cnt(is_(ROAD)).alias("road_components"),
        cnt(is_(ROAD) & (a >= 100)).alias("road_segments"),
        F.coalesce(F.max(F.when(is_(ROAD), a)), F.lit(0)).alias("largest_road"),
        tot(is_(BUILTUP)).alias("builtup_px"), cnt(is_(BUILTUP)).alias("builtup_components"),
        cnt(is_(BUILTUP) & (a >= MIN_CLUSTER_PX)).alias("clusters"),
        cnt(building).alias("n_buildings"), tot(building).alias("building_px"),
        cnt(building & a.between(ROOFTOP_MIN_PX, ROOFTOP_MAX_PX) & (aspect() <= ROOFTOP_MAX_ASPECT)
            & (fill() >= ROOFTOP_MIN_FILL)).alias("rooftops"),
        tot(is_(WATER)).alias("water_px"), cnt(is_(WATER)).alias("water_components"),
        cnt(is_(WATER) & (a >= 200)).alias("water_bodies_200"),
        cnt(is_(WATER) & (a >= 500)).alias("water_bodies_500"),
        F.coalesce(F.max(F.when(is_(WATER) & (a >= 200), a)), F.lit(0)).alias("largest_water"),
        tot(is_(BRIDGE)).alias("bridge_px"), cnt(is_(BRIDGE) & (a >= 30)).alias("bridges"))


def _skeleton_or_area(base: DataFrame, gsd: float, skeleton: DataFrame | None) -> DataFrame:
    """``length_m``: skeleton pixels * gsd, or road area / 3 when none is given."""
    if skeleton is None:
        return base.withColumn("skel_px", F.lit(None).cast("long")).withColumn("length_m", F.col("road_px") * gsd / 3.0)
    return base.join(skeleton.select("raster_id", "skel_px"), "raster_id", "left").withColumn(
        "skel_px", F.coalesce("skel_px", F.lit(0))).withColumn("length_m", F.col("skel_px") * gsd)


def raster_base(mask: DataFrame, labelled: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalog rows with component measures; rasters without any class get zeros.

    ``labelled`` holds labelled runs, or what ``component_stats`` makes of them.
    """
    s = component_summary(labelled if "area_px" in labelled.columns else component_stats(labelled))
    cat = catalog.select("raster_id", (F.col("width").cast("long") * F.col("height")).alias("total_px"))
    return cat.join(s, "raster_id", "left").fillna(0)


def spatial_measures(mask: DataFrame, labelled: DataFrame, catalog: DataFrame, gsd: float, frame,
                     skeleton: DataFrame | None = None) -> DataFrame:
    """Unrounded spatial measures, one row per raster."""
    base = _skeleton_or_area(raster_base(mask, labelled, catalog), gsd, skeleton)
    near = builtup_nearness(mask, gsd, frame)
    m = base.join(near, "raster_id", "left").fillna(0, ["bu_px", "near_road_px", "near_water_px"])
    return (
        m.withColumn("largest_pct", pct(F.col("largest_road"), F.col("road_px")))
        .withColumn("frag", F.col("clusters") / F.greatest(F.col("bu_px") / 10000.0, F.lit(0.01)))
        .withColumn("road_pct", pct(F.col("near_road_px"), F.col("bu_px")))
        .withColumn("water_pct", pct(F.col("near_water_px"), F.col("bu_px")))
    )


def spatial_report(measures: DataFrame, gsd: float) -> DataFrame:
    """The eleven published fields, rounded."""
    return measures.select(
        "raster_id", F.lit(float(gsd)).alias("pixel_size_m"), rnd("length_m", 1).alias("road_total_length_m"),
        F.col("road_components").alias("road_connected_components"),
        rnd("largest_pct", 1).alias("road_largest_component_pct"), F.col("clusters").alias("builtup_clusters"),
        rnd("road_pct", 1).alias("builtup_road_access_pct"), rnd("water_pct", 1).alias("builtup_water_proximity_pct"),
        F.col("water_bodies_500").alias("water_bodies"),
        rnd(F.col("water_px") * (gsd * gsd), 1).alias("water_total_area_m2"),
        rnd("frag", 2).alias("settlement_fragmentation_index"), recommendations().alias("recommendations"))


def bridge_locations(stats: DataFrame, gsd: float) -> DataFrame:
    """Bridge rows of at least 30 px: truncated centroid and area."""
    return stats.filter((F.col("class_id") == BRIDGE) & (F.col("area_px") >= 30)).select(
        "raster_id", "comp_id", F.floor(F.round("cx", 9)).cast("int").alias("x_px"), F.floor(F.round("cy", 9)).cast("int").alias("y_px"),
        rnd(F.col("area_px") * (gsd * gsd), 1).alias("area_m2"))


def confidence_coverage(conf: DataFrame) -> DataFrame:
    """Share of pixels strictly above 0.7, in percent; ``conf`` as runs, or as boxes of rows ``r0`` to ``r1``."""
    n = run_len() * (F.col("r1") - F.col("r0") + 1) if "r0" in conf.columns else run_len()
    return conf.groupBy("raster_id").agg(
        (F.lit(100.0) * F.sum(F.when(F.col("conf") > 0.7, n).otherwise(0)) / F.sum(n)).alias("coverage"))


def village_report(mask: DataFrame, labelled: DataFrame, catalog: DataFrame, gsd: float,
                   conf: DataFrame | None = None, skeleton: DataFrame | None = None) -> DataFrame:
    """Village statistics as flat columns, one row per raster."""
    b = _skeleton_or_area(raster_base(mask, labelled, catalog), gsd, skeleton)
    px = gsd * gsd
    m2 = lambda c: rnd(F.col(c) * px, 1)
    cov = lambda c: rnd(pct(F.col(c), F.col("total_px")), 2)
    ha = F.col("total_px") * px / 10000.0
    if conf is not None:
        b = b.join(confidence_coverage(conf), "raster_id", "left")
    else:
        b = b.withColumn("coverage", F.lit(0.0))
    return b.select(
        "raster_id", rnd(F.col("total_px") * px, 1).alias("total_area_m2"), rnd(ha, 2).alias("total_area_ha"),
        "road_px", m2("road_px").alias("road_area_m2"), cov("road_px").alias("road_coverage_pct"),
        rnd("length_m", 1).alias("road_length_m"),
        F.when(F.col("skel_px") > 0, rnd(F.col("road_px") * gsd / F.col("skel_px"), 2)).otherwise(0.0).alias("road_avg_width_m"),
        F.col("road_components").alias("road_components"), "road_segments",
        "builtup_px", m2("builtup_px").alias("builtup_area_m2"), cov("builtup_px").alias("builtup_coverage_pct"),
        "builtup_components", "n_buildings",
        F.when(F.col("n_buildings") > 0, rnd(F.col("building_px") / F.col("n_buildings") * px, 1)).otherwise(0.0).alias("avg_building_area_m2"),
        rnd(F.col("n_buildings") / F.greatest(ha, F.lit(0.01)), 1).alias("building_density_per_ha"),
        F.col("rooftops").alias("rooftop_count"),
        "water_px", m2("water_px").alias("water_area_m2"), cov("water_px").alias("water_coverage_pct"),
        "water_components", F.col("water_bodies_200").alias("n_water_bodies"), m2("largest_water").alias("largest_body_m2"),
        "bridge_px", m2("bridge_px").alias("bridge_area_m2"), cov("bridge_px").alias("bridge_coverage_pct"),
        F.col("bridges").alias("n_bridges"), rnd(F.coalesce("coverage", F.lit(0.0)), 1).alias("confidence_coverage_pct"))


def explainability(mask: DataFrame, conf: DataFrame, catalog: DataFrame, threshold: float = 0.70) -> DataFrame:
    """High-confidence share, uncertain pixels and mean confidence per class.

    ``mask`` as runs, or as boxes to be burned (``burn.box_layer``); ``conf`` as runs, or as boxes of rows ``r0`` to ``r1``.
    """
    burned = ("m",) if "value" in mask.columns else ()
    o = lay_over({"m": mask if burned else box_layer_of(mask, "class_id"), "v": box_layer_of(conf, "conf")}, burned, under="v")
    n, cls = run_len(), F.coalesce("m", F.lit(0))
    mean = lambda k: rnd(F.coalesce(F.sum(F.when(cls == k, n * F.col("v"))) / F.sum(F.when(cls == k, n)), F.lit(0.0)), 4)
    high = F.sum(F.when(F.col("v") >= threshold, n).otherwise(0))
    g = o.groupBy("raster_id").agg(
        (F.lit(100.0) * high / F.sum(n)).alias("high"), F.sum(F.when(F.col("v") < threshold, n).otherwise(0)).alias("uncertain_px"),
        *[mean(k).alias(f"mean_conf_{k}") for k in range(5)])
    return g.select("raster_id", rnd("high", 2).alias("high_confidence_pct"),
                    rnd(F.lit(100.0) - F.col("high"), 2).alias("review_required_pct"), "uncertain_px",
                    *[f"mean_conf_{k}" for k in range(5)])


def zone_table(uncertain: DataFrame, conf: DataFrame, extra: dict[str, DataFrame], min_px: int = MIN_REVIEW_ZONE_PX) -> DataFrame:
    """Labelled zones -> area, centroid, mean confidence and overlap with ``extra`` layers.

    ``conf`` must cover every row of a raster without gaps, as runs or as boxes of rows ``r0`` to ``r1``.
    """
    n = run_len()
    o = lay_over({"comp_id": box_layer_of(uncertain, "comp_id"), "v": box_layer_of(conf, "conf"),
                  **{k: box_layer_of(v) for k, v in extra.items()}}, under="comp_id")
    return o.groupBy("raster_id", "comp_id").agg(
        F.sum(n).alias("area_px"),
        F.sum((F.col("c0") + F.col("c1")) * n).alias("_sx2"), F.sum(F.col("row") * n).alias("_sy"),
        (F.sum(F.col("v") * n) / F.sum(n)).alias("mean_conf"),
        *[F.coalesce(F.sum(F.when(F.col(k).isNotNull(), n)), F.lit(0)).alias(k) for k in extra],
    ).filter(F.col("area_px") >= min_px).select(
        "raster_id", "comp_id", "area_px", (F.col("_sx2") / 2.0 / F.col("area_px")).alias("cx"),
        (F.col("_sy").cast("double") / F.col("area_px")).alias("cy"), "mean_conf", *extra)
