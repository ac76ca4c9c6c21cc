"""Bias trials over stored scores.

Raising one class's bias only ever moves pixels towards that class, so each
pixel is summed up by how many grid values leave it unchanged. A whole grid is
then one scan and one histogram of at most ``classes^2 * (grid + 1)`` rows; no
pixel is multiplied by the grid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridrun.constants import N_CLASSES
from gridrun.functions.logits import add_bias, argmax

# Search grids per class: fixed values.
GRIDS = {
    0: [-2.0, -1.0, -0.5, 0.0],
    1: [0.25 * i for i in range(14)],
    2: [0.5 * i for i in range(13)],
    3: [-0.5, -0.25, 0.0, 0.25, 0.5],
    4: [-0.5, 0.0, 0.5],
}


def _grid(values):
    return F.array(*[F.lit(float(v)) for v in values])


def margin_histogram(logits: DataFrame, cls: int, grid: list[float], bias: list[float], ties_to_class: bool = False) -> DataFrame:
    """``(gt, other, losing, n)``: ``losing`` = how many (ascending) grid values do not win the pixel.

    ``other`` is the class chosen without ``cls``. A tie goes to the lower class
    id, or to ``cls`` with ``ties_to_class``.
    """
    others = [k for k in range(N_CLASSES) if k != cls]
    oz = F.array(*[F.col("z")[k] + F.lit(float(bias[k])) for k in others])
    d = logits.select("gt", F.col("z")[cls].alias("zc"), oz.alias("oz"))
    d = d.select("gt", "zc", F.array_max("oz").alias("om"),
                 F.element_at(F.array(*[F.lit(k) for k in others]), F.array_position("oz", F.array_max("oz")).cast("int")).alias("other"))
    tie = F.lit(True) if ties_to_class else F.col("other") > cls
    loses = lambda v: ~((F.col("zc") + v > F.col("om")) | ((F.col("zc") + v == F.col("om")) & tie))
    return d.select("gt", "other", F.size(F.filter(_grid(grid), loses)).alias("losing")).groupBy(
        "gt", "other", "losing").agg(F.count("*").alias("n"))


def bias_sweep(logits: DataFrame, cls: int, grid: list[float], bias: list[float]) -> DataFrame:
    """tp, fp, fn and P/R/F1/IoU of one class for every trial bias."""
    h = margin_histogram(logits, cls, grid, bias, ties_to_class=True)
    truth = F.col("gt") == cls
    c = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    cells = h.agg(F.array(*[F.struct(
        F.lit(float(v)).alias("bias"),
        c(truth & (F.col("losing") <= i)).alias("tp"), c(~truth & (F.col("losing") <= i)).alias("fp"),
        c(truth & (F.col("losing") > i)).alias("fn")) for i, v in enumerate(grid)]).alias("cells"))
    eps = F.lit(1e-10)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return (
        cells.select(F.explode("cells").alias("c")).select("c.*")
        .withColumn("precision", tp / (tp + fp + eps)).withColumn("recall", tp / (tp + fn + eps))
        .withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + eps))
        .withColumn("iou", tp / (tp + fp + fn + eps))
    )


def trial_miou(logits: DataFrame, cls: int, grid: list[float], bias: list[float]) -> DataFrame:
    """Foreground mean IoU for every trial value of one class's bias.

    The histogram, not the pixels, is repeated per grid value.
    """
    h = margin_histogram(logits, cls, grid, bias)
    trial = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(v)).alias("value")) for i, v in enumerate(grid)]))
    cell = h.select("*", trial.alias("t")).select(
        "gt", F.when(F.col("losing") <= F.col("t.i"), cls).otherwise(F.col("other")).alias("pred"), "n", "t.value")
    cell = cell.select("*", F.explode(F.sequence(F.lit(1), F.lit(N_CLASSES - 1))).alias("k"))
    is_gt, is_pred = F.col("gt") == F.col("k"), F.col("pred") == F.col("k")
    s = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    per = cell.groupBy("value", "k").agg(s(is_gt & is_pred).alias("i"), s(is_gt | is_pred).alias("u"), s(is_gt).alias("g"))
    return per.groupBy("value").agg(F.coalesce(
        F.avg(F.when(F.col("g") > 0, F.col("i") / (F.col("u") + F.lit(1e-10)))), F.lit(0.0)).alias("miou"))


def _trial_scores(rows, cls: int, grid: list[float]) -> list[float]:
    """The same from collected histogram rows (a few hundred at most)."""
    scores = []
    for i in range(len(grid)):
        inter, union, truth = [0] * N_CLASSES, [0] * N_CLASSES, [0] * N_CLASSES
        for r in rows:
            pred = cls if r["losing"] <= i else r["other"]
            truth[r["gt"]] += r["n"]
            union[r["gt"]] += r["n"]
            if pred == r["gt"]:
                inter[pred] += r["n"]
            else:
                union[pred] += r["n"]
        iou = [inter[k] / (union[k] + 1e-10) for k in range(1, N_CLASSES) if truth[k]]
        scores.append(sum(iou) / len(iou) if iou else 0.0)
    return scores


def coordinate_descent(logits: DataFrame, rounds: int = 3, grids: dict[int, list[float]] | None = None) -> tuple[list[float], float]:
    """One class at a time, accept a value that gains more than 1e-5.

    Each class of each round is one job whose result is the few grid rows.
    """
    grids = grids or GRIDS
    logits = logits.select("gt", "z").persist()
    try:
        bias = [0.0] * N_CLASSES
        trial = lambda c, grid: _trial_scores(margin_histogram(logits, c, grid, bias).collect(), c, grid)
        best = trial(0, [0.0])[0]
        for _ in range(rounds):
            changed = False
            for c in range(N_CLASSES):
                for v, got in zip(grids[c], trial(c, grids[c])):
                    if got > best + 1e-5:
                        best, changed = got, True
                        bias = [v if i == c else b for i, b in enumerate(bias)]
            if not changed:
                break
        return bias, best
    finally:
        logits.unpersist()


def predict(logits: DataFrame, bias: list[float]) -> DataFrame:
    return logits.withColumn("pred", argmax(add_bias("z", bias)))
