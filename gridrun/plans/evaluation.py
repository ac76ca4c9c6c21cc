"""Comparison of evaluation runs and sparse-class diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridrun.constants import BRIDGE, BRIDGE_GATE
from gridrun.operators.onerow import with_row
from gridrun.operators.ranking import running


def compare_runs(base: DataFrame, other: DataFrame) -> DataFrame:
    """Per-class metrics of two runs side by side with their deltas.

    Both inputs hold one row per class.
    """
    b = base.select("class_id", "gt_pixels", F.col("iou").alias("base_iou"), F.col("recall").alias("base_recall"))
    c = other.select("class_id", F.col("iou").alias("calibrated_iou"), F.col("recall").alias("calibrated_recall"))
    j = b.join(c, "class_id")
    delta = j.agg((F.avg("calibrated_iou") - F.avg("base_iou")).alias("d")).scalar()
    return j.select("class_id", "gt_pixels", "base_iou", "calibrated_iou",
                    (F.col("calibrated_iou") - F.col("base_iou")).alias("delta_iou"),
                    (F.col("calibrated_recall") - F.col("base_recall")).alias("delta_recall"), delta.alias("delta_fg_miou"))


def probability_diagnostics(px: DataFrame, patch: str) -> DataFrame:
    """One row on how the sparse class scores; ``px`` has gt, pred and its probability ``pb``."""
    t, raw = F.col("gt") == BRIDGE, F.col("pred") == BRIDGE
    per = px.groupBy(patch).agg(
        F.count_if(raw).alias("raw"), F.count_if(raw & (F.col("pb") > BRIDGE_GATE)).alias("post"), F.count_if(t).alias("t"),
        F.sum(F.when(~t, F.col("pb"))).alias("off"), F.count_if(~t).alias("off_n"))
    has = F.col("t") > 0
    flags = per.agg(
        F.count("*").alias("patches"), F.count_if(F.expr("raw = 0")).alias("never_predicted"),
        F.count_if(F.expr("raw > 0 and post = 0")).alias("removed_by_gate"),
        F.round(F.sum(F.when(has, F.col("off"))) / F.sum(F.when(has, F.col("off_n"))), 6).alias("prob_mean_off"))
    on = px.filter(t)
    p95 = ranked_percentile(on, "pb", 0.95).select(F.round("value", 6).alias("prob_p95_on"))
    return flags.transform(with_row, on.agg(F.round(F.avg("pb"), 6).alias("prob_mean_on"))).transform(with_row, p95)      # one row each


def ranked_percentile(df: DataFrame, col: str, p: float) -> DataFrame:
    """Exact percentile, linear between ranks, as one row ``value``.

    Equal values are counted before any shuffle; ranks come from range-partitioned running sums, so no task holds all values.
    """
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("_n"))
    d = running(counts, [], [col], {"_before": ("sum", "_n")})
    d = d.transform(with_row, df.agg((F.lit(p) * (F.count(col) - 1)).alias("_h")))
    part, last = F.col("_h") - F.floor("_h"), F.col("_before") + F.col("_n")
    holds = lambda rank: (F.col("_before") < rank) & (rank <= last)
    low = F.when(holds(F.floor("_h") + 1), F.col(col) * (1 - part))
    return d.agg((F.sum(low) + F.coalesce(F.sum(F.when(holds(F.floor("_h") + 2), F.col(col) * part)), F.lit(0.0))).alias("value"))
