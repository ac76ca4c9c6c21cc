"""Deterministic, seeded sampling: every draw is a hash of its key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridrun.functions.draws import draw, uniform
from gridrun.operators.catalog import clamp_window
from gridrun.operators.ranking import number_rows, running
from gridrun.operators.onerow import with_row


def class_weights(centroids: DataFrame) -> DataFrame:
    """Inverse counts per class, normalised to one."""
    c = centroids.groupBy("class_id").agg(F.count("*").alias("n"))
    total = c.agg(F.sum(F.lit(1.0) / F.col("n")).alias("t"))
    return c.transform(with_row, total).select("class_id", "n", (F.lit(1.0) / F.col("n") / F.col("t")).alias("weight"))


def class_balanced_windows(slots: DataFrame, centroids: DataFrame, catalog: DataFrame, patch: int, seed: int = 42) -> DataFrame:
    """One window per slot ``(slot, raster_id)``: class by weight, centroid uniform, jitter of patch/4.

    The class is the minimum of ``-ln(u)/weight`` over the classes present in
    the raster; the centroid is addressed by number, so no candidate list is built.
    """
    per = centroids.groupBy("raster_id", "class_id").agg(F.count("*").alias("m"))
    w = class_weights(centroids).select("class_id", "weight")
    key = -F.log(uniform(seed, "slot", "class_id")) / F.col("weight")
    pick = (slots.join(per.join(F.broadcast(w), "class_id"), "raster_id")
            .groupBy("slot", "raster_id").agg(F.min_by(F.struct("class_id", "m"), key).alias("p"))
            .select("slot", "raster_id", "p.class_id", (F.floor(uniform(seed + 1, "slot") * F.col("p.m")) + 1).cast("long").alias("k")))
    numbered = number_rows(centroids, ["raster_id", "class_id"], ["feature_id"], "k")
    jitter = lambda s: F.floor((uniform(seed + s, "slot") * 2 - 1) * (patch // 4)).cast("int")
    d = pick.join(numbered, ["raster_id", "class_id", "k"]).join(catalog.select("raster_id", "height", "width"), "raster_id")
    return d.select("slot", "raster_id", "class_id", clamp_window(F.col("row") + jitter(2), patch, F.col("height")).alias("y"),
                    clamp_window(F.col("col") + jitter(3), patch, F.col("width")).alias("x"))


def uniform_windows(slots: DataFrame, catalog: DataFrame, patch: int, seed: int = 7) -> DataFrame:
    d = slots.join(catalog.select("raster_id", "height", "width"), "raster_id")
    at = lambda s, size: F.floor(uniform(seed + s, "slot") * (F.greatest(F.col(size) - patch, F.lit(0)) + 1)).cast("int")
    return d.select("slot", "raster_id", at(0, "height").alias("y"), at(1, "width").alias("x"))


def mixed_windows(slots: DataFrame, centroids: DataFrame, catalog: DataFrame, patch: int, share: float = 0.5, seed: int = 42) -> DataFrame:
    """``share`` of the slots around a centroid, the rest anywhere."""
    flag = uniform(seed + 9, "slot") < share
    a = class_balanced_windows(slots.filter(flag), centroids, catalog, patch, seed)
    return a.select("slot", "raster_id", "y", "x", F.lit("centroid").alias("kind")).unionByName(
        uniform_windows(slots.filter(~flag), catalog, patch).withColumn("kind", F.lit("uniform")))


def dominant_weights(patches: DataFrame) -> DataFrame:
    """Weight of each patch = 1 / number of patches with the same dominant class."""
    order = (1, 2, 3, 4, 0)
    arr = F.array(*[F.col(f"px{k}") for k in order])
    d = patches.withColumn("dominant", F.element_at(F.array(*[F.lit(k) for k in order]), F.array_position(arr, F.array_max(arr)).cast("int")))
    n = d.groupBy("dominant").agg(F.count("*").alias("n"))
    return d.join(F.broadcast(n), "dominant").withColumn("weight", F.lit(1.0) / F.greatest("n", F.lit(1))).drop("n")


def oversample_weight(px: Column) -> Column:
    return F.lit(1.0) + F.when(px > 0, 8.0).otherwise(0.0) + F.when(px > 200, 4.0).otherwise(0.0)


def weighted_draws(df: DataFrame, weight: str, order: list[str], seed: int = 42) -> DataFrame:
    """Number of draws per row when exactly as many rows are drawn with replacement as there are.

    Systematic draws: the rows lie end to end, as long as their weights (to 12 digits), and points at even steps from
    a seeded start fall on them. Running sums are range-partitioned; ``order`` must be a total order.
    """
    d = df.withColumn("_w", F.round(F.col(weight) * 1e12).cast("decimal(19,0)"))
    d = running(d, [], order, {"_from": ("sum", "_w")})
    t = d.agg(F.count("*").cast("decimal(19,0)").alias("_n"), F.sum("_w").alias("_t"), F.floor(uniform(seed, F.lit("start")) * 1e6).cast("decimal(7,0)").alias("_u"))
    points = lambda at: F.expr(f"((({at}) * _n * 1000000 + _u * _t) div (_t * 1000000))")
    return d.transform(with_row, t).withColumn("draws", (points("_from + _w") - points("_from")).cast("long")).drop("_w", "_from", "_n", "_t", "_u")


def stratified_split(df: DataFrame, stratum: str, key: list[str], train: float = 0.7, cap: int | None = None, seed: int = 42) -> DataFrame:
    """Train/test flag by hash rank within each stratum; ``cap`` limits a stratum first."""
    d = df.withColumn("_h", draw(seed, *key))
    d = number_rows(d, [stratum], ["_h", *key], "_r", few=True)
    if cap is not None:
        d = d.filter(F.col("_r") <= cap)
    n = d.groupBy(stratum).agg(F.count("*").alias("_n"))
    return d.join(F.broadcast(n), stratum).withColumn("part", F.when(F.col("_r") <= F.floor(F.col("_n") * train), "train").otherwise("test")).drop("_h", "_r", "_n")


def foreground_gate(cands: DataFrame, min_ratio: float = 0.03, retry: float = 0.7, seed: int = 42) -> DataFrame:
    """First accepted attempt per slot; ``cands`` has slot, attempt, fg_ratio.

    A poor window is retried with probability ``retry``; the last attempt is always taken.
    """
    last = cands.groupBy("slot").agg(F.max("attempt").alias("_last"))
    ok = (F.col("fg_ratio") >= min_ratio) | (uniform(seed, "slot", "attempt") >= retry) | (F.col("attempt") == F.col("_last"))
    rest = [c for c in cands.columns if c not in ("slot",)]
    return cands.join(last, "slot").filter(ok).groupBy("slot").agg(F.min_by(F.struct(*rest), "attempt").alias("r")).select("slot", "r.*")


def slot_targets(entries: DataFrame, targets: DataFrame, epochs: int, stride: int) -> DataFrame:
    """Epoch slots ``idx`` -> raster; every ``stride``-th slot goes round-robin over target rasters.

    ``entries`` and ``targets`` are raster ids; slots are spread from the
    entries themselves (``epochs`` passes over them).
    """
    e = number_rows(entries.select("raster_id"), [], ["raster_id"], "pos")
    n = entries.agg(F.count("*").alias("n"))
    t = number_rows(targets.select(F.col("raster_id").alias("target_id")), [], ["target_id"], "tpos")
    m = targets.agg(F.count("*").alias("m"))
    d = e.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).transform(with_row, n).transform(with_row, m)
    d = d.withColumn("idx", F.col("pass") * F.col("n") + F.col("pos") - 1)
    forced = F.col("idx") % stride == 0
    d = d.withColumn("forced", forced).withColumn(
        "tpos", F.when(forced & (F.col("m") > 0), F.floor(F.col("idx") / stride) % F.col("m") + 1))
    return d.join(t, "tpos", "left").select("idx", "pass", F.coalesce("target_id", "raster_id").alias("raster_id"), "forced")
