"""Dilation, erosion, closing and opening of run layers.

A kernel is a list of ``(dy, half_width)``: a square of side 2r+1 has the same
half-width on every row, a disc has ``round(sqrt(r^2 - dy^2))``. Pixels outside
the frame count as background when dilating and as foreground when eroding.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridrun.operators.strips import spread


def rect(width: int, height: int) -> list[tuple[int, int]]:
    """Kernel rows of a width x height rectangle (odd sides)."""
    return [(dy, width // 2) for dy in range(-(height // 2), height // 2 + 1)]


def disc(radius: int) -> list[tuple[int, int]]:
    """Kernel rows of a disc of side 2*radius+1; ties round half up."""
    return [(dy, int(math.floor(math.sqrt(radius * radius - dy * dy) + 0.5))) for dy in range(-radius, radius + 1)]


def radius_px(metres: float, gsd: float) -> int:
    return max(1, int(round(metres / gsd)))


def _with_frame(runs: DataFrame, frame) -> DataFrame:
    """Attach width and height: fixed ``(w, h)`` or a catalog table."""
    if isinstance(frame, tuple):
        return runs.withColumn("width", F.lit(frame[0])).withColumn("height", F.lit(frame[1]))
    return runs.join(frame.select("raster_id", "width", "height"), "raster_id")


def dilate(runs: DataFrame, kernel, frame) -> DataFrame:
    """Union of the kernel placed on every pixel, clipped to the frame; done in strips of rows (see ``strips.spread``)."""
    return spread(_with_frame(runs.select("raster_id", "row", "c0", "c1"), frame), kernel)


def erode(runs: DataFrame, kernel, frame) -> DataFrame:
    """Pixels whose whole kernel lies on foreground (or outside the frame)."""
    return spread(_with_frame(runs.select("raster_id", "row", "c0", "c1"), frame), kernel, erode=True)


def close(runs: DataFrame, kernel, frame) -> DataFrame:
    return erode(dilate(runs, kernel, frame), kernel, frame)


def open_(runs: DataFrame, kernel, frame) -> DataFrame:
    return dilate(erode(runs, kernel, frame), kernel, frame)
