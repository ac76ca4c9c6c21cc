"""Row rules and small scalar formulas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridrun.constants import RGB_MEAN, RGB_STD

# Fixed values of the admission rules.
ALLOWED_EXT = ["png", "jpg", "jpeg", "tif", "tiff"]
ALLOWED_MIME = ["image/png", "image/jpeg", "image/tiff"]
MAX_BYTES, MAX_DIM, MAX_NAME = 64 * 1024 * 1024, 8192, 255
ALLOWED_EPSG = [32643, 32644, 3857]


def admission(name="name", mime="mime", size="bytes", dim="max_dim") -> Column:
    """First failing rule of an asset, else ``ok``."""
    n = F.trim(F.coalesce(F.col(name), F.lit("")))
    ext = F.lower(F.regexp_extract(n, r"\.([^.]+)$", 1))
    return (F.when(n == "", "missing name")
            .when(F.arrays_overlap(F.split(n, r"[/\\]"), F.array(F.lit(".."))) | n.startswith("/"), "unsafe name")
            .when(F.length(n) > MAX_NAME, "name too long").when(~ext.isin(ALLOWED_EXT), "unsupported extension")
            .when(~F.lower(F.trim(F.coalesce(F.col(mime), F.lit("")))).isin(ALLOWED_MIME), "unsupported type")
            .when(F.col(size) == 0, "empty file").when(F.col(size) > MAX_BYTES, "file too large")
            .when(F.col(dim) > MAX_DIM, "dimension too large").otherwise("ok"))


def normalise_rgb(red, green, blue) -> list[Column]:
    return [(F.col(c) / 255.0 - F.lit(m)) / F.lit(s) for c, m, s in zip((red, green, blue), RGB_MEAN, RGB_STD)]


def count_tiles(height, width, patch: int, overlap: int) -> Column:
    """Tiles of an overlapping cover with a pushed-back last row and column."""
    one = lambda n: F.when(n <= patch, 1).otherwise(F.ceil((n - patch) / (patch - overlap)) + 1)
    return (one(height) * one(width)).cast("long")


def inference_seconds(tiles: Column, height: Column, width: Column, gpu: bool, flips: bool) -> Column:
    """Estimated wall clock: batches of four tiles plus finishing time."""
    batches = F.greatest(F.lit(1), F.floor((tiles + 3) / 4))
    per = (1.8 if gpu else 7.0) * (3.0 if flips else 1.0)
    return batches * per + F.greatest(F.lit(8.0), height.cast("double") * width / 1e6 * 0.8)


def annotation_quality() -> tuple[Column, Column]:
    """Grade A/B/C and its reason from px, z_dist and distinct_score."""
    low = (F.col("px") < 50) | (F.col("distinct_score") < 0.03)
    mid = (F.col("px") < 250) | (F.col("z_dist") < 0.8)
    return (F.when(low, "C").when(mid, "B").otherwise("A"),
            F.when(low, "insufficient visible signal").when(mid, "weak contrast or small footprint").otherwise("clear footprint and measurable contrast"))


def any_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds)
