"""Writers and readers of masks, layers, reports and quarantine sets."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridrun.operators.runs import window_clip
from gridrun.session import shared_folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared checkpoint location."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def write_mask(mask: DataFrame, path: str, strip: int = 4096) -> None:
    """Class runs in folders of ``strip`` rows each, sorted, so that a window prunes folders, files and row groups.

    The folder's column is named after the height, ``strip_<height>``, so a reader needs no other metadata. Rows are
    dealt by ranges of (strip, raster, row): a raster that holds most of the runs is split over many writers, and a
    file spans few rasters and rows.
    """
    name = f"strip_{strip}"
    d = mask.withColumn(name, F.floor(F.col("row") / strip).cast("int"))
    d.repartitionByRange(name, "raster_id", "row").sortWithinPartitions(name, "raster_id", "row", "c0").write.mode("overwrite").partitionBy(name).parquet(path)


def _strip_column(stored: DataFrame) -> tuple[str, int]:
    name = next(c for c in stored.columns if c.startswith("strip_"))
    return name, int(name.removeprefix("strip_"))


def read_mask(spark: SparkSession, path: str) -> DataFrame:
    stored = spark.read.parquet(path)
    return stored.drop(_strip_column(stored)[0])


def read_window(spark: SparkSession, path: str, r0: int, c0: int, h: int, w: int, rasters: tuple[int, ...] = ()) -> DataFrame:
    """Runs of a stored mask inside a pixel window, cut to it, of all or some rasters.

    Only folders of strips that the window meets are listed; rows, columns and rasters are tested against the
    statistics of row groups. A window outside of all strips, or without height or width, gives no rows.
    """
    stored = spark.read.parquet(path)
    name, height = _strip_column(stored)
    d = stored.filter(F.col(name).between(r0 // height, (r0 + h - 1) // height))
    if rasters:
        d = d.filter(F.col("raster_id").isin(*rasters))
    return window_clip(d, r0, c0, h, w).filter("c0 <= c1").drop(name)


def write_layers(layers: DataFrame, path: str) -> None:
    layers.write.mode("overwrite").partitionBy("layer").parquet(path)


def layer_counts(layers: DataFrame, names: DataFrame) -> DataFrame:
    """Rows per layer, zero for layers without any."""
    n = layers.groupBy("layer").agg(F.count("*").alias("n"))
    return names.join(n, "layer", "left").fillna(0, ["n"])


def write_json(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def write_csv(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").option("header", True).csv(path)


def quarantine(catalog: DataFrame, good_path: str, bad_path: str, apply: bool) -> DataFrame:
    """Split readable from unreadable assets; the action log says what was (or would be) done."""
    if apply:
        catalog.filter("readable").write.mode("overwrite").parquet(good_path)
        catalog.filter("not readable").write.mode("overwrite").parquet(bad_path)
    return catalog.filter("not readable").select("raster_id", F.lit("moved" if apply else "would move").alias("action"))
