"""Ranked field-visit queue and the survey document built around it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridrun.constants import (BUILTUP, DEDUP_DISTANCE_M, MAX_QUEUE_ITEMS, MIN_CLUSTER_PX, MIN_REVIEW_ZONE_PX, ROAD,
                               ROAD_ACCESS_M, SCORE_WEIGHTS, WATER, WATER_PROXIMITY_M)
from gridrun.functions.scoring import (NO_PRIORITY, access_label, pct, priority_line, reason_text, rnd, score_parts,
                                       structure_estimate, weighted_total)
from gridrun.operators.components import label_components
from gridrun.operators.morphology import radius_px
from gridrun.operators.ranking import keep_spaced, number_in_frame
from gridrun.operators.runs import class_layer
from gridrun.plans.spatial import near_layer, zone_table
from gridrun.session import durable

ORDER = ["-score", "kind", "idx"]


def visit_candidates(mask: DataFrame, conf: DataFrame, uncertain: DataFrame, gsd: float, frame) -> DataFrame:
    """Settlement clusters and uncertain zones with their scores, before suppression.

    ``uncertain`` holds the labelled low-confidence runs.
    """
    bu = class_layer(mask, BUILTUP)
    labelled = label_components(bu.withColumn("class_id", F.lit(BUILTUP)), frame)
    water = near_layer(mask, WATER, None, WATER_PROXIMITY_M, gsd, frame) if radius_px(WATER_PROXIMITY_M, gsd) <= 64 else None
    water_for = lambda target: water if water is not None else near_layer(mask, WATER, target, WATER_PROXIMITY_M, gsd, frame)
    # One pass per label layer gives area, centroid, confidence and overlaps together.
    comps = zone_table(labelled, conf, {"near_road": near_layer(mask, ROAD, bu, ROAD_ACCESS_M, gsd, frame),
                                        "near_water": water_for(bu)}, 0)
    comps = durable(comps)
    frag = comps.groupBy("raster_id").agg(
        F.round(F.round(F.count_if(F.col("area_px") >= MIN_CLUSTER_PX)
                        / F.greatest(F.sum("area_px") / 10000.0, F.lit(0.01)), 6), 2).alias("frag"))
    clusters = number_in_frame(comps.filter(F.col("area_px") >= MIN_CLUSTER_PX), "idx").select(
        "raster_id", F.lit(0).alias("kind"), "idx", "area_px", "cx", "cy", "mean_conf",
        pct(F.col("near_road"), F.col("area_px")).alias("road_pct"), pct(F.col("near_water"), F.col("area_px")).alias("water_pct"))
    zones = durable(zone_table(uncertain, conf, {"builtup": bu, "near_water": water_for(uncertain)}, MIN_REVIEW_ZONE_PX)
                    .filter(F.col("builtup") <= 0.5 * F.col("area_px")))
    zones = number_in_frame(zones, "idx").select(
        "raster_id", F.lit(1).alias("kind"), "idx", "area_px", "cx", "cy", "mean_conf",
        F.lit(0.0).alias("road_pct"), pct(F.col("near_water"), F.col("area_px")).alias("water_pct"))
    c = clusters.unionByName(zones).join(frag, "raster_id", "left").fillna(0.0, ["frag"])
    is_bu = F.col("kind") == 0
    area_m2 = F.col("area_px") * (gsd * gsd)
    parts = score_parts(F.col("mean_conf"), F.col("road_pct"), area_m2, F.col("water_pct"), F.col("frag"), is_bu)
    return (
        c.select("*", *[v.alias(k) for k, v in parts.items()])
        .withColumn("score", weighted_total())
        .withColumn("item_type", F.when(is_bu, "settlement_cluster").otherwise("uncertain_zone"))
        .withColumn("label", F.concat(F.when(is_bu, "Settlement Cluster ").otherwise("Uncertain Zone "), F.col("idx").cast("string")))
        .withColumn("access", access_label(F.col("road_pct"), is_bu))
        .withColumn("area_m2", area_m2)
    )


def visit_queue(candidates: DataFrame, gsd: float, max_items: int = MAX_QUEUE_ITEMS) -> DataFrame:
    """Candidates -> the published queue rows."""
    kept = keep_spaced(candidates, radius_px(DEDUP_DISTANCE_M, gsd), max_items, ORDER)
    return (
        kept.withColumn("reason", reason_text())
        .select("raster_id", "rank", rnd("score", 1).alias("score"), rnd("cx", 1).alias("centroid_x_px"),
                rnd("cy", 1).alias("centroid_y_px"), "item_type", "label", "reason", rnd("area_m2", 1).alias("settlement_area_m2"),
                F.when(F.col("kind") == 0, structure_estimate(F.col("area_m2"))).otherwise(0).cast("long").alias("n_structures"),
                rnd("mean_conf", 4).alias("mean_confidence"), "access", *SCORE_WEIGHTS,
                rnd(weighted_total(), 2).alias("weighted_total"))
    )


def top_priorities(queue: DataFrame, catalog: DataFrame, n: int = 3) -> DataFrame:
    """First ``n`` sentences per raster; a fixed line where the queue is empty."""
    lines = queue.filter(F.col("rank") <= n).select("raster_id", "rank", priority_line().alias("line"))
    return catalog.select("raster_id").join(lines, "raster_id", "left").select(
        "raster_id", F.coalesce("rank", F.lit(1)).cast("long").alias("rank"), F.coalesce("line", F.lit(NO_PRIORITY)).alias("line"))
