"""Averaging of score variants and overlapping tiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridrun.constants import N_CLASSES

PX = ["raster_id", "row", "col"]


def mean_scores(parts: DataFrame) -> DataFrame:
    """Mean of ``z`` per pixel over all parts that cover it; one column per class, no explode."""
    return parts.groupBy(*PX).agg(*[F.avg(F.col("z")[k]).alias(f"_z{k}") for k in range(N_CLASSES)]).select(
        *PX, F.array(*[f"_z{k}" for k in range(N_CLASSES)]).alias("z"))


def flip_average(plain: DataFrame, h_flipped: DataFrame, v_flipped: DataFrame, width: int, height: int) -> DataFrame:
    """Mean of scores on the image, its mirror and its upside-down copy, flipped back."""
    return mean_scores(reduce(DataFrame.unionByName, [
        plain.select(*PX, "z"),
        h_flipped.select("raster_id", "row", (F.lit(width - 1) - F.col("col")).alias("col"), "z"),
        v_flipped.select("raster_id", (F.lit(height - 1) - F.col("row")).alias("row"), "col", "z")]))


def upsample(low: DataFrame, in_size: tuple[int, int], out_size: tuple[int, int]) -> DataFrame:
    """Bilinear resize of scores (pixel centres, corners not aligned).

    Every low-resolution pixel sends its weighted value to the output pixels it
    touches; one aggregate sums the taps.
    """
    (h, w), (oh, ow) = in_size, out_size

    def taps(n_in, n_out):
        src = lambda i: F.greatest((i + F.lit(0.5)) * F.lit(n_in / n_out) - F.lit(0.5), F.lit(0.0))
        return src

    reach = lambda col, n_in, n_out: F.explode(F.sequence(
        F.greatest(F.floor((F.col(col) - F.lit(1.0)) * (n_out / n_in)) - 1, F.lit(0)),
        F.least(F.ceil((F.col(col) + F.lit(2.0)) * (n_out / n_in)), F.lit(n_out - 1))).cast("array<int>"))

    def weight(src_col, tap, n_in):
        lo = F.floor(src_col)
        frac = src_col - lo
        hi = F.least(lo + 1, F.lit(n_in - 1))
        return F.when(lo == tap, F.lit(1.0) - frac).otherwise(0.0) + F.when(hi == tap, frac).otherwise(0.0)

    d = low.select("raster_id", "row", "col", "z", reach("row", h, oh).alias("orow")).select(
        "*", reach("col", w, ow).alias("ocol"))
    wt = weight(taps(h, oh)(F.col("orow")), F.col("row"), h) * weight(taps(w, ow)(F.col("ocol")), F.col("col"), w)
    d = d.withColumn("w", wt).filter("w > 0")
    return d.groupBy("raster_id", F.col("orow").alias("row"), F.col("ocol").alias("col")).agg(
        *[F.sum(F.col("z")[k] * F.col("w")).alias(f"_z{k}") for k in range(N_CLASSES)]).select(
        *PX, F.array(*[f"_z{k}" for k in range(N_CLASSES)]).alias("z"))


def strip_stitch(strips: DataFrame, overlap: int) -> DataFrame:
    """Class per pixel where later strips overwrite from row ``start + overlap/2``.

    ``strips``: ``raster_id, strip, start, row, col, class_id``; the first strip
    may write all of its rows.
    """
    may = (F.col("strip") == 0) | (F.col("row") >= F.col("start") + overlap // 2)
    return strips.filter(may).groupBy(*PX).agg(F.max_by("class_id", "strip").alias("class_id"))
