"""Statistics and decisions about the sparse class, over the patch catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridrun.operators.ranking import number_rows
from gridrun.operators.onerow import with_row


def distribution(df: DataFrame, col: str) -> DataFrame:
    """Count, sum, mean, median, min, max and p95 (linear interpolation)."""
    c = F.col(col)
    return df.agg(F.count("*").alias("n"), F.sum(c).alias("total"), F.round(F.avg(c), 6).alias("mean"), F.percentile(c, 0.5).alias("median"),
                  F.min(c).alias("lo"), F.max(c).alias("hi"), F.round(F.percentile(c, 0.95), 6).alias("p95"))


def instance_catalog(boxes: DataFrame, catalog: DataFrame, pad: int = 96, min_side: int = 256) -> DataFrame:
    """Padded crop corner (at least ``min_side`` wide), box size and in-frame pixels per instance."""
    d = boxes.join(catalog.select("raster_id", "height", "width"), "raster_id")
    corner = lambda o, n: F.greatest(F.lit(0), F.col(o) + F.floor(F.col(n) / 2) - F.floor(F.greatest(F.lit(min_side), F.col(n) + 2 * pad) / 2)).cast("int")
    inside = lambda o, n, size: F.least(F.col(o) + F.col(n), F.col(size)) - F.col(o)
    return d.select("raster_id", "feature_id", corner("c0", "w").alias("crop_x"), corner("r0", "h").alias("crop_y"),
                    F.col("w").alias("bbox_w"), F.col("h").alias("bbox_h"), (inside("c0", "w", "width") * inside("r0", "h", "height")).alias("px"))


def class_shares(p: DataFrame) -> DataFrame:
    s = p.agg(*[F.sum(f"px{k}").alias(f"s{k}") for k in range(1, 5)])
    ratio = lambda k: F.round(F.col("s2") / F.greatest(F.lit(1), F.col(f"s{k}")), 6)
    return s.select(F.round(100.0 * F.col("s2") / F.greatest(F.lit(1), F.expr("s1+s2+s3+s4")), 6).alias("sparse_pct_of_fg"),
                    ratio(1).alias("to_road"), ratio(3).alias("to_built"), ratio(4).alias("to_water"))


def visibility(p: DataFrame) -> DataFrame:
    n = lambda c, a: F.count_if(F.expr(c)).alias(a)
    return p.agg(n("px2 < 50", "low"), n("px2 >= 50 and px2 < 200", "mid"), n("px2 >= 200", "high"),
                 n("px1 > px2 * 5", "road_dominant"), n("px3 > px2 * 5", "built_dominant"))


def admission(p: DataFrame) -> DataFrame:
    d = p.agg(F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "val").alias("val"))
    return d.withColumn("status", F.when((F.col("train") < 8) | (F.col("val") < 4), "BLOCKED").otherwise("READY"))


def detector_feasibility(instances: DataFrame) -> DataFrame:
    """Median box, share of boxes with a usable short side, and a weighted score."""
    side = F.least("bbox_w", "bbox_h")
    share = lambda c: F.avg(c.cast("int"))
    return instances.agg(
        F.percentile("bbox_w", 0.5).alias("median_w"), F.percentile("bbox_h", 0.5).alias("median_h"),
        F.round(share(side >= 16), 6).alias("ge16"), F.round(share(side >= 4), 6).alias("ge4"),
        F.round(F.lit(0.45) * share(side >= 16) + F.lit(0.35) * share(F.col("px") >= 30), 6).alias("score"))


def _ordered(p: DataFrame) -> DataFrame:
    return number_rows(p, [], ["-px2", "raster_id", "y", "x"], "pos")


def top_share(p: DataFrame, at_least: int, divisor: int) -> DataFrame:
    """The best ``max(at_least, n / divisor)`` patches by sparse-class pixels."""
    o = _ordered(p)
    n = o.agg(F.greatest(F.lit(at_least), F.floor(F.count("*") / divisor)).alias("_k"))
    return o.transform(with_row, n).filter("pos <= _k").drop("_k")


def curriculum(p: DataFrame) -> DataFrame:
    """Easy third first (phase 0), then everything (phase 1)."""
    o = _ordered(p)
    n = o.agg(F.greatest(F.lit(8), F.floor(F.count("*") / 3)).alias("_k"))
    easy = o.transform(with_row, n).filter("pos <= _k").drop("_k")
    return easy.withColumn("phase", F.lit(0)).unionByName(o.withColumn("phase", F.lit(1)))


def hard_positive_records(catalog: DataFrame, patches: DataFrame, passes: int) -> DataFrame:
    e = number_rows(catalog.select("raster_id"), [], ["raster_id"], "pos")
    n = catalog.agg(F.count("*").alias("n"))
    r = number_rows(patches.select("raster_id", "y", "x", "px2"), ["raster_id"], ["-px2", "y", "x"], "rk")
    m = patches.groupBy("raster_id").agg(F.count("*").alias("m"))
    slots = e.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1)))).transform(with_row, n).join(m, "raster_id")
    slots = slots.select("raster_id", (F.col("pass") * F.col("n") + F.col("pos") - 1).alias("idx"), (F.col("pass") % F.col("m") + 1).alias("rk"))
    return slots.join(r, ["raster_id", "rk"]).select("idx", "raster_id", "y", "x")


def exposure(p: DataFrame, batch_size: int, batches: int | None = None) -> DataFrame:
    """Batch, patch and target-pixel counters over all batches, or over the first ``batches``."""
    o = number_rows(p, [], ["raster_id", "y", "x"], "pos").withColumn("batch", F.floor((F.col("pos") - 1) / batch_size))
    o = o if batches is None else o.filter(F.col("batch") < batches)
    per = o.groupBy("batch").agg(F.count("*").alias("n"), F.sum("px2").alias("t"))
    return per.agg(F.count("*").alias("batches"), F.sum("n").alias("patches"), F.count_if(F.col("t") > 0).alias("batches_with_target"), F.sum("t").alias("target_px"))


def forensics(p: DataFrame) -> DataFrame:
    """One-row summary of the sparse class's catalog."""
    c = F.col("px2")
    return p.agg(
        F.count("*").alias("patches"), F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "val").alias("val"),
        F.sum(c).alias("total_px"), F.round(F.avg(c), 6).alias("mean_px"), F.percentile(c, 0.5).alias("p50"), F.round(F.percentile(c, 0.95), 6).alias("p95"),
        F.count_if(c < 50).alias("low"), F.count_if(c >= 200).alias("high"),
        F.round(100.0 * F.sum(c) / F.greatest(F.lit(1), F.sum(F.expr("px1+px2+px3+px4"))), 6).alias("sparse_pct_of_fg"))
