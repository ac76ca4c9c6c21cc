"""Ordered analytics over metric series ``(run, epoch, metric)``.

A series may hold most of all rows, so ordered work goes through the
range-partitioned helpers of ``ranking`` instead of one window per run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridrun.operators.ranking import number_rows, running, top_k


def number_epochs(rows: DataFrame) -> DataFrame:
    """``(run, ts, event_id, metric)`` -> ``(run, epoch, metric)``."""
    return number_rows(rows, ["run"], ["ts", "event_id"], "epoch").select("run", "epoch", "metric")


def stability(h: DataFrame, last: int = 3) -> DataFrame:
    """``1 / (1 + population std of the last values)`` per run."""
    tail = top_k(h, ["run"], ["-epoch"], last)
    return tail.groupBy("run").agg((F.lit(1.0) / (F.lit(1.0) + F.stddev_pop("metric"))).alias("stability"))


def first_and_peak(h: DataFrame) -> DataFrame:
    """First epoch above zero and the best value."""
    return h.groupBy("run").agg(F.min(F.when(F.col("metric") > 0, F.col("epoch"))).alias("first_positive_epoch"),
                                F.max("metric").alias("peak_metric"))


def new_best(h: DataFrame) -> DataFrame:
    """Running best before each epoch and whether the epoch beats it."""
    r = running(h, ["run"], ["epoch"], {"best_before": ("max", "metric")})
    return r.withColumn("is_best", F.col("best_before").isNull() | (F.col("metric") > F.col("best_before")))


def zero_streaks(h: DataFrame, eps: float = 1e-9) -> DataFrame:
    """Length of the run of (near-)zero values that ends at each epoch."""
    live = h.withColumn("_live", F.when(F.col("metric") > eps, F.col("epoch")))
    r = running(live, ["run"], ["epoch"], {"_last": ("max", "_live")})
    return r.withColumn("streak", F.when(F.col("_live").isNotNull(), F.lit(0)).otherwise(
        F.col("epoch") - F.coalesce("_last", F.lit(0))).cast("long")).drop("_live", "_last")


def early_stop(h: DataFrame, patience: int) -> DataFrame:
    """Longest zero streak and the first epoch at which it reached ``patience``."""
    return zero_streaks(h).groupBy("run").agg(
        F.max("streak").alias("longest_streak"), F.min(F.when(F.col("streak") >= patience, F.col("epoch"))).alias("stop_epoch"))


def eta(h: DataFrame, total: DataFrame) -> DataFrame:
    """Mean duration so far and the time left; ``total`` is (run, total)."""
    r = running(h, ["run"], ["epoch"], {"_s": ("sum", "metric")})
    mean = (F.col("_s") + F.col("metric")) / F.col("epoch")
    return r.join(total, "run").select("run", "epoch", mean.alias("mean_time"), (mean * (F.col("total") - F.col("epoch"))).alias("eta"))


def ema(h: DataFrame, decay: float = 0.99) -> DataFrame:
    """Final exponential moving average per run, started at the first value.

    Written as a weighted sum, so it is an ordinary partial aggregate and no
    series is folded in one task.
    """
    n = h.groupBy("run").agg(F.max("epoch").alias("n"))
    d = F.lit(decay)
    weight = F.when(F.col("epoch") == 1, F.pow(d, F.col("n") - 1)).otherwise((F.lit(1.0) - d) * F.pow(d, F.col("n") - F.col("epoch")))
    return h.join(n, "run").groupBy("run").agg(F.sum(weight * F.col("metric")).alias("ema"))


def training_summary(h: DataFrame) -> DataFrame:
    """Best epoch (first on ties), its value, and the last epoch's value."""
    best = F.max_by(F.struct("epoch", "metric"), F.struct(F.col("metric"), -F.col("epoch")))
    return h.groupBy("run").agg(best.alias("b"), F.max_by("metric", "epoch").alias("final_metric"), F.max("epoch").alias("total_epochs")).select(
        "run", F.col("b.epoch").alias("best_epoch"), F.col("b.metric").alias("best_metric"), "final_metric", "total_epochs")


def rank_results(results: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """Global multi-key ranking."""
    return number_rows(results, [], order, name)
