"""Overlap and nearness of run layers without joining pairs of runs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridrun.operators.components import _cut
from gridrun.operators.runs import ROW, as_layer, coverage, overlay, run_len


def overlap_px(labelled: DataFrame, layers: dict[str, DataFrame]) -> DataFrame:
    """Pixels of each component covered by each presence layer; 0 is kept.

    ``labelled`` holds one class, so its runs do not overlap.
    """
    o = overlay({"comp_id": as_layer(labelled, "comp_id"), **{k: as_layer(v) for k, v in layers.items()}})
    return o.filter("comp_id is not null").groupBy("raster_id", "comp_id").agg(*[
        F.coalesce(F.sum(F.when(F.col(k).isNotNull(), run_len())), F.lit(0)).alias(k) for k in layers])


def zonal_mean(labelled: DataFrame, values: DataFrame) -> DataFrame:
    """Mean of a value layer ``(raster_id, row, c0, c1, value)`` inside each component."""
    o = overlay({"comp_id": as_layer(labelled, "comp_id"), "v": values.select(*ROW, "c0", "c1", F.col("value"))})
    return o.filter("comp_id is not null and v is not null").groupBy("raster_id", "comp_id").agg(
        (F.sum(F.col("v") * run_len()) / F.sum(run_len())).alias("mean_value"))


def near_pixels(target: DataFrame, source: DataFrame, radius: int, tile: int = 1024) -> DataFrame:
    """Parts of ``target`` runs within a disc of ``radius`` around any ``source`` pixel.

    For radii of hundreds or thousands of pixels: no dilated mask is built and
    no run pairs are formed. Source runs go to every tile they can reach, so one
    task holds at most ``(tile + 2*radius)^2`` pixels. Inside a tile the nearest
    source row per column gives a half-width, and the union of these intervals
    is the dilation (the disc's half-width only shrinks with distance).
    """
    side = tile + 2 * radius
    t = _cut(target.select("raster_id", "row", "c0", "c1"), tile).withColumn("src", F.lit(False))
    reach = lambda lo, hi: F.explode(
        F.sequence(F.floor((lo - radius) / tile), F.floor((hi + radius) / tile)).cast("array<int>"))
    s = (
        source.select("raster_id", "row", "c0", "c1", reach(F.col("row"), F.col("row")).alias("tr"))
        .select("*", reach(F.col("c0"), F.col("c1")).alias("tc"))
        .withColumn("src", F.lit(True))
        .join(t.select("raster_id", "tr", "tc").distinct(), ["raster_id", "tr", "tc"], "left_semi")
    )

    def bitmap(row, c0, c1):
        d = np.zeros((side, side + 1), np.int32)
        np.add.at(d, (row, np.clip(c0, 0, side)), 1)
        np.add.at(d, (row, np.clip(c1 + 1, 0, side)), -1)
        return np.cumsum(d, axis=1)[:, :side] > 0

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, x0 = int(pdf["tr"].iloc[0]) * tile - radius, int(pdf["tc"].iloc[0]) * tile - radius
        row, c0, c1 = (pdf[c].to_numpy() for c in ("row", "c0", "c1"))
        row, c0, c1, src = row - r0, c0 - x0, c1 - x0, pdf["src"].to_numpy()
        if not src.any():
            return pdf.iloc[:0][["raster_id", "row", "c0", "c1"]]
        on = bitmap(row[src], c0[src], c1[src])
        idx = np.arange(side, dtype=np.int64)[:, None]
        far = np.int64(4 * side)
        above = idx - np.maximum.accumulate(np.where(on, idx, -far), axis=0)
        below = np.minimum.accumulate(np.where(on, idx, far)[::-1], axis=0)[::-1] - idx
        g = np.minimum(above, below)[radius:radius + tile]
        r, x = np.nonzero(g <= radius)
        hw = np.floor(np.sqrt(radius * radius - g[r, x] ** 2) + 0.5).astype(np.int64)
        d = np.zeros((tile, side + 1), np.int32)
        np.add.at(d, (r, np.maximum(x - hw, 0)), 1)
        np.add.at(d, (r, np.minimum(x + hw + 1, side)), -1)
        hit = bitmap(row[~src], c0[~src], c1[~src])[radius:radius + tile]
        hit &= np.cumsum(d, axis=1)[:, :side] > 0
        edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        rs, a = np.nonzero(edge == 1)
        z = np.nonzero(edge == -1)[1] - 1
        return pd.DataFrame({"raster_id": pdf["raster_id"].iloc[0], "row": rs + radius + r0, "c0": a + x0, "c1": z + x0})

    hits = t.unionByName(s).groupBy("raster_id", "tr", "tc").applyInPandas(
        near, "raster_id long, row int, c0 int, c1 int")
    return coverage(hits)
