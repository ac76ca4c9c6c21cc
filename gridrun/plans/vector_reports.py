"""Reports over vector layers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridrun.operators.vector import layer_defects, repair


def stakeholder_indicators(clipped: DataFrame, catalog: DataFrame) -> DataFrame:
    """Coverage, density and ratio indicators per village from clipped polygons."""
    per = clipped.groupBy("raster_id").agg(
        *[F.coalesce(F.sum(F.when(F.col("class_id") == k, F.col("area_m2"))), F.lit(0.0)).alias(a) for k, a in ((1, "road"), (3, "built"), (4, "water"))],
        *[F.count_if(F.col("class_id") == k).alias(n) for k, n in ((1, "n1"), (3, "n3"), (4, "n4"))])
    d = catalog.select("raster_id", F.abs(F.col("gt_a") * F.col("gt_e") * F.col("width") * F.col("height")).alias("village")).join(
        per, "raster_id", "left").fillna(0, ["road", "built", "water", "n1", "n3", "n4"])
    pc = lambda c: F.lit(100.0) * c / F.nullif(F.col("village"), F.lit(0.0))
    return d.select(
        "raster_id", pc(F.col("road")).alias("road_coverage_pct"), pc(F.col("built")).alias("builtup_coverage_pct"),
        pc(F.col("water")).alias("water_coverage_pct"), pc(F.col("road") + F.col("built")).alias("infrastructure_density_pct"),
        F.col("n1").alias("road_segments_count"), F.col("n3").alias("builtup_polygons_count"), F.col("n4").alias("water_bodies_count"),
        (F.col("n3") / (F.col("village") / 10000.0)).alias("building_density_per_ha"),
        (F.col("n4") / (F.col("village") / 1000000.0)).alias("water_body_density_per_km2"),
        (F.col("built") / F.nullif(F.col("water"), F.lit(0.0))).alias("built_to_water_ratio"))


def repair_summary(features: DataFrame, expected: DataFrame) -> DataFrame:
    """Feature and defect counts per layer before and after the repair."""
    part = lambda df, tag: layer_defects(df, expected, count=True).select(
        "source", "class_id", *[F.col(c).alias(f"{c}_{tag}") for c in ("features", "invalid", "empty", "duplicate")])
    return part(features, "before").join(part(repair(features), "after"), ["source", "class_id"])
