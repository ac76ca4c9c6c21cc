"""Loss terms as pixel statistics (evaluated, not differentiated)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridrun.constants import N_CLASSES
from gridrun.functions.logits import cross_entropy, softmax
from gridrun.operators.ranking import number_rows
from gridrun.operators.onerow import with_row


def _soft_sums(px: DataFrame, key: str) -> DataFrame:
    """Per patch and class: sums of p, t and p*t."""
    p = px.select(key, "gt", softmax("z").alias("p"))
    t = lambda c: F.when(F.col("gt") == c, 1.0).otherwise(0.0)
    return p.groupBy(key).agg(*[
        x for c in range(N_CLASSES) for x in (
            F.sum(F.col("p")[c]).alias(f"p{c}"), F.sum(t(c)).alias(f"t{c}"),
            F.sum(F.col("p")[c] * t(c)).alias(f"i{c}"))], F.count("*").alias("n"))


def loss_terms(px: DataFrame, key: str, gamma: float = 2.0, smooth: float = 1e-4, label_eps: float = 0.05,
               min_sparse_px: int = 100, tv=(0.7, 0.3, 1.5, 1e-6)) -> DataFrame:
    """One row: cross entropy, focal, soft Dice, smoothed Dice, focal Tversky.

    The Dice of the sparse class (2) is left out of the smoothed variant when
    the truth has fewer than ``min_sparse_px`` of its pixels.
    """
    ce = F.col("ce")
    flat = px.select(cross_entropy("z", "gt").alias("ce")).agg(
        F.avg(ce).alias("ce"), F.avg(F.pow(F.lit(1.0) - F.exp(-ce), F.lit(gamma)) * ce).alias("focal"))
    s = _soft_sums(px, key)
    c = lambda n: F.col(n)
    dice = lambda k: (2.0 * c(f"i{k}") + smooth) / (c(f"p{k}") + c(f"t{k}") + smooth)
    e, u = 1.0 - label_eps, label_eps / N_CLASSES
    sdice = lambda k: (2.0 * (c(f"i{k}") * e + c(f"p{k}") * u) + smooth) / (c(f"p{k}") + c(f"t{k}") * e + c("n") * u + smooth)
    a, b, g, eps = tv
    tversky = lambda k: (c(f"i{k}") + eps) / (
        c(f"i{k}") + a * (c(f"p{k}") - c(f"i{k}")) + b * (c(f"t{k}") - c(f"i{k}")) + eps)
    fg = range(1, N_CLASSES)
    sums = s.agg(
        *[F.avg(dice(k)).alias(f"d{k}") for k in fg], *[F.avg(sdice(k)).alias(f"s{k}") for k in fg],
        *[F.avg(F.pow(F.greatest(F.lit(1.0) - tversky(k), F.lit(0.0)), F.lit(g))).alias(f"v{k}") for k in fg],
        F.sum("t2").alias("sparse"))
    mean = lambda cols: sum(cols[1:], cols[0]) / len(cols)
    one = lambda n: F.lit(1.0) - c(n)
    smoothed = F.when(c("sparse") < min_sparse_px, mean([one(f"s{k}") for k in fg if k != 2])).otherwise(mean([one(f"s{k}") for k in fg]))
    return sums.transform(with_row, flat).select(      # one row on each side
        "ce", "focal", mean([one(f"d{k}") for k in fg]).alias("soft_dice"), smoothed.alias("smoothed_dice"),
        mean([c(f"v{k}") for k in fg]).alias("focal_tversky"))


def hard_pixels(px: DataFrame, batch: str, order: list[str], ratio: float = 0.30) -> DataFrame:
    """Pixels whose cross entropy reaches the k-th largest of their batch, ties kept.

    k = max(1, int(ratio * n)). Ranks come from range-partitioned numbering, so
    a huge batch is spread over many tasks; the k-th row gives the threshold.
    """
    d = number_rows(px.withColumn("ce", cross_entropy("z", "gt")), [batch], ["-ce", *order], "_rn")
    k = d.groupBy(batch).agg(F.greatest(F.lit(1), F.floor(F.lit(ratio) * F.count("*"))).alias("_k"))
    cut = d.join(k, batch).filter(F.col("_rn") == F.col("_k")).select(batch, F.col("ce").alias("_cut"))
    return d.join(cut, batch).filter(F.col("ce") >= F.col("_cut")).drop("_rn", "_cut")
