"""Accuracy metrics from confusion counts.

Counting works on run segments; only ``(raster, gt, pred)`` totals, at most 25
per raster, ever reach the later steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridrun.constants import BRIDGE
from gridrun.operators.runs import as_layer, overlay, run_len


def paired_segments(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """Truth x prediction as segments ``(raster_id, row, c0, c1, gt, pred)``; 0 is background."""
    o = overlay({"gt": as_layer(truth, "class_id"), "pred": as_layer(pred, "class_id")})
    return o.fillna(0, ["gt", "pred"])


def confusion(truth: DataFrame, pred: DataFrame, catalog: DataFrame) -> DataFrame:
    """``(raster_id, gt, pred, n)``; background is the frame minus what is painted."""
    return confusion_of(paired_segments(truth, pred), catalog)


def confusion_of(segments: DataFrame, catalog: DataFrame) -> DataFrame:
    """``confusion`` of truth and prediction that are segments already."""
    seg = segments.select("raster_id", F.explode(F.array(
        F.struct("gt", "pred", run_len().alias("n")),
        F.struct(F.lit(0).alias("gt"), F.lit(0).alias("pred"), (-run_len()).alias("n")))).alias("e")
    ).select("raster_id", "e.gt", "e.pred", "e.n")
    frame = catalog.select("raster_id", F.lit(0).alias("gt"), F.lit(0).alias("pred"),
                           (F.col("width").cast("long") * F.col("height")).alias("n"))
    return seg.unionByName(frame).groupBy("raster_id", "gt", "pred").agg(F.sum("n").alias("n"))


def class_counts(cm: DataFrame, classes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """tp, truth and predicted pixels per class; every class appears."""
    ev = cm.select(*by, F.explode(F.array(
        F.struct(F.col("gt").alias("class_id"), F.when(F.col("gt") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"),
                 F.col("n").alias("g"), F.lit(0).cast("long").alias("p")),
        F.struct(F.col("pred").alias("class_id"), F.lit(0).cast("long").alias("tp"),
                 F.lit(0).cast("long").alias("g"), F.col("n").alias("p")))).alias("e"))
    got = ev.groupBy(*by, F.col("e.class_id").alias("class_id")).agg(
        F.sum("e.tp").alias("tp"), F.sum("e.g").alias("gt_pixels"), F.sum("e.p").alias("pred_pixels"))
    if by:
        full = got.select(*by).distinct().withColumn("class_id", F.explode(F.sequence(F.lit(0), F.lit(4))))
        got = full.join(got, [*by, "class_id"], "left")
        return got.join(F.broadcast(classes.select("class_id", "name")), "class_id").fillna(
            0, ["tp", "gt_pixels", "pred_pixels"])
    return F.broadcast(classes.select("class_id", "name")).join(got, "class_id", "left").fillna(
        0, ["tp", "gt_pixels", "pred_pixels"])


def pr_metrics(counts: DataFrame, eps: float = 1e-10) -> DataFrame:
    """IoU, precision, recall and F1 with ``eps`` in every denominator."""
    tp, g, p = (F.col(c).cast("double") for c in ("tp", "gt_pixels", "pred_pixels"))
    return (
        counts.withColumn("iou", tp / (g + p - tp + eps))
        .withColumn("precision", tp / (p + eps))
        .withColumn("recall", tp / (g + eps))
        .withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + eps))
    )


def fg_mean(value: str = "iou", present: Column | None = None) -> Column:
    """Mean over foreground classes that occur in the truth; 0 if none does."""
    present = F.col("gt_pixels") > 0 if present is None else present
    return F.coalesce(F.avg(F.when((F.col("class_id") > 0) & present, F.col(value))), F.lit(0.0))


def health_label() -> Column:
    """Verdict per class; needs gt_pixels, iou, recall and precision."""
    return (F.when(F.col("gt_pixels") == 0, "absent").when(F.col("iou") < 0.1, "critical")
            .when(F.col("iou") < 0.3, "weak").when(F.col("recall") < 0.3, "low_recall")
            .when(F.col("precision") < 0.3, "low_precision").otherwise("ok"))


def top_confusions(cm: DataFrame, classes: DataFrame, n: int | None = None) -> DataFrame:
    """Off-diagonal cells of truth classes 1..4 with their share of the truth class."""
    cell = cm.groupBy("gt", "pred").agg(F.sum("n").alias("pixels"))
    total = cell.groupBy("gt").agg(F.sum("pixels").alias("gt_px"))
    names = F.broadcast(classes.select("class_id", "name"))
    out = (
        cell.join(total, "gt").filter("gt > 0 and gt <> pred and pixels > 0 and gt_px > 0")
        .join(names.withColumnsRenamed({"class_id": "gt", "name": "gt_name"}), "gt")
        .join(names.withColumnsRenamed({"class_id": "pred", "name": "pred_name"}), "pred")
        .withColumn("pct_of_gt", 100.0 * F.col("pixels") / F.col("gt_px"))
        .select("gt", "pred", "gt_name", "pred_name", "pixels", "pct_of_gt"))
    return out if n is None else out.orderBy(F.desc("pixels"), "gt", "pred").limit(n)


def failure_modes(cm: DataFrame) -> DataFrame:
    """Where truth pixels of the sparse class went, as one row."""
    row = cm.filter(F.col("gt") == BRIDGE)
    s = lambda k: F.coalesce(F.sum(F.when(F.col("pred") == k, F.col("n"))), F.lit(0)).cast("long")
    return row.agg(s(0).alias("as_background"), s(1).alias("as_road"), s(2).alias("as_bridge"),
                   s(3).alias("as_built_up"), s(4).alias("as_water")).withColumn(
        "missed", F.expr("as_background + as_road + as_built_up + as_water")).withColumn(
        "hard_case_ratio", F.col("missed") / F.greatest(F.col("missed") + F.col("as_bridge"), F.lit(1)).cast("double"))
