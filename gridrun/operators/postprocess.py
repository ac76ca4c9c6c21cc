"""Mask cleaning stages. Each takes and returns a class mask in run form.

Stages depend on each other's output and roads and water overwrite other
classes, so the order matters. Each stage's result is materialised once in the
checkpoint folder: the next stage reads it several times.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridrun.constants import BRIDGE, BRIDGE_GATE, BUILTUP, ROAD, WATER, WATER_GATE
from gridrun.operators.components import aspect, component_stats, keep_components, label_components
from gridrun.operators.morphology import close, dilate, disc, open_, rect
from gridrun.operators.proximity import overlap_px
from gridrun.operators.runs import as_layer, class_layer, join_touching, merge_runs, overlay, repaint, run_len, subtract
from gridrun.session import durable

LOG = logging.getLogger(__name__)


def _labelled(runs: DataFrame, frame, class_id: int) -> DataFrame:
    return label_components(runs.withColumn("class_id", F.lit(class_id)), frame)


def _gate(runs: DataFrame, prob: DataFrame | None, threshold: float) -> DataFrame:
    """Keep pixels whose class probability is above the threshold (strictly)."""
    if prob is None:
        return runs
    o = overlay({"m": as_layer(runs), "p": as_layer(prob, "prob")})
    return merge_runs(o.filter((F.col("m").isNotNull()) & (F.col("p") > threshold)).drop("m", "p"))


def road_gap_fill(mask: DataFrame, frame, max_gap: int = 25, min_px: int = 10) -> DataFrame:
    """Union of three closings of the road layer, grown into background only.

    Rasters with under ``min_px`` road pixels stay as they are.
    """
    road = class_layer(mask, ROAD)
    enough = road.groupBy("raster_id").agg(F.sum(run_len()).alias("n")).filter(F.col("n") >= min_px).select("raster_id")
    road = road.join(enough, "raster_id", "left_semi")
    parts = [close(road, rect(w, h), frame) for w, h in ((3, 3), (max_gap, 3), (3, max_gap))]
    filled = merge_runs(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    return repaint(mask, ROAD, filled, background_only=True)


def refine_roads(mask: DataFrame, frame, min_px: int = 200) -> DataFrame:
    """Close 5x5, drop small components, write the result over any class."""
    closed = close(class_layer(mask, ROAD), rect(5, 5), frame)
    return repaint(mask, ROAD, keep_components(_labelled(closed, frame, ROAD), min_px))


def refine_water(mask: DataFrame, frame, prob: DataFrame | None = None, min_px: int = 500) -> DataFrame:
    """Probability gate, open (disc 1), close (disc 5), drop small components, write over any class."""
    water = open_(_gate(class_layer(mask, WATER), prob, WATER_GATE), disc(1), frame)
    water = close(water, disc(5), frame)
    return repaint(mask, WATER, keep_components(_labelled(water, frame, WATER), min_px))


def refine_bridges(mask: DataFrame, frame, prob: DataFrame | None = None, min_px: int = 20, max_px: int = 50000) -> DataFrame:
    """Probability gate, size filter, then trim to the 101x101 surroundings of road or water."""
    bridge = _gate(class_layer(mask, BRIDGE), prob, BRIDGE_GATE)
    kept = keep_components(_labelled(bridge, frame, BRIDGE), min_px, max_px)
    near = dilate(mask.filter(F.col("class_id").isin(ROAD, WATER)).drop("class_id"), rect(101, 101), frame)
    o = overlay({"a": as_layer(kept), "b": as_layer(near)}).filter("a is not null and b is not null").drop("a", "b")
    return repaint(mask, BRIDGE, o)


def spans_road(labelled: DataFrame, road: DataFrame, frame, reach: int = 80) -> DataFrame:
    """Components with road on both sides of their box midline within a square reach.

    The square dilation of a component meets a road pixel exactly when some
    component run, widened by ``reach``, covers it. Road rows are cut into
    blocks of ``reach`` rows; per (component, block) only column extents count.
    """
    stats = component_stats(labelled).select(
        "raster_id", "comp_id", F.floor((F.col("x0") + F.col("x1")) / 2).alias("xm"), F.floor((F.col("y0") + F.col("y1")) / 2).alias("ym"))
    # Vertical spread of the component by row, merged per component: bounded by its own rows.
    grown = _dilate_components(labelled, reach, frame)
    cols = lambda lo, hi: F.explode(F.sequence(F.floor(lo / 256), F.floor(hi / 256)))
    g = grown.select("raster_id", "comp_id", "row", "c0", "c1", cols(F.col("c0"), F.col("c1")).alias("tc"))
    r = road.select("raster_id", "row", F.col("c0").alias("r0"), F.col("c1").alias("r1"), cols(F.col("c0"), F.col("c1")).alias("tc"))
    hit = g.join(r, ["raster_id", "row", "tc"]).filter("c0 <= r1 and r0 <= c1").select(
        "raster_id", "comp_id", "row", F.greatest("c0", "r0").alias("a"), F.least("c1", "r1").alias("z"))
    ext = hit.groupBy("raster_id", "comp_id").agg(
        F.min("a").alias("xa"), F.max("z").alias("xz"), F.min("row").alias("ya"), F.max("row").alias("yz"))
    return ext.join(stats, ["raster_id", "comp_id"]).filter(
        "(xa < xm and xz >= xm) or (ya < ym and yz >= ym)").select("raster_id", "comp_id")


def _dilate_components(labelled: DataFrame, reach: int, frame) -> DataFrame:
    """Square dilation of every component on its own, by doubling."""
    from gridrun.operators.runs import coverage
    keys = ("raster_id", "comp_id", "row")
    cur = labelled.select("raster_id", "comp_id", (F.col("row") - reach).alias("row"),
                          F.greatest(F.col("c0") - reach, F.lit(0)).alias("c0"), F.least(F.col("c1") + reach, F.lit(frame[0] - 1)).alias("c1"))
    done, total = 1, 2 * reach + 1
    while done < total:
        step = min(done, total - done)
        cur = coverage(cur.withColumn("row", F.explode(F.array(F.col("row"), F.col("row") + step))), keys)
        done += step
    return cur.filter(F.col("row").between(0, frame[1] - 1))


def bridge_recovery(mask: DataFrame, frame, min_px: int = 20, max_px: int = 20000, min_aspect: float = 1.2) -> DataFrame:
    """Elongated built-up components near road and water, or spanning road, become bridges."""
    labelled = durable(_labelled(class_layer(mask, BUILTUP), frame, BUILTUP))
    shape = component_stats(labelled).filter(F.col("area_px").between(min_px, max_px) & (aspect() >= min_aspect))
    cand = labelled.join(shape.select("raster_id", "comp_id"), ["raster_id", "comp_id"], "left_semi")
    road = class_layer(mask, ROAD)
    near = overlap_px(cand, {"r": dilate(road, rect(101, 101), frame),
                             "w": dilate(class_layer(mask, WATER), rect(281, 281), frame)}).filter("r > 0 and w > 0")
    chosen = near.select("raster_id", "comp_id").unionByName(spans_road(cand, road, frame)).distinct()
    new = cand.join(chosen, ["raster_id", "comp_id"], "left_semi")
    o = overlay({"m": as_layer(mask, "class_id"), "n": as_layer(new)})
    return join_touching(o.withColumn("class_id", F.when(F.col("n").isNotNull(), BRIDGE).otherwise(F.col("m")).cast("int")).drop("m", "n"))


Stage = tuple[str, Callable[[DataFrame], DataFrame]]


class StageError(RuntimeError):
    """Raised by a stage that can't treat its mask; nothing else may be passed over."""


def run_stages(mask: DataFrame, stages: list[Stage], strict: bool = True) -> DataFrame:
    """Apply stages in order.

    Without ``strict`` a stage that raises ``StageError`` is logged and passed over; what Spark raises (a lost
    executor, a full disk) always ends the run, so a mask is never left uncleaned unnoticed.
    """
    mask = durable(mask)
    for name, fn in stages:
        try:
            mask = durable(fn(mask))
        except StageError:
            if strict:
                raise
            LOG.exception("stage passed over: %s", name)
    return mask


def default_stages(frame, water_prob: DataFrame | None = None, bridge_prob: DataFrame | None = None,
                   gap_fill: bool = True, recovery: bool = True) -> list[Stage]:
    stages: list[Stage] = []
    if gap_fill:
        stages.append(("road_gap_fill", lambda m: road_gap_fill(m, frame)))
    stages += [("refine_roads", lambda m: refine_roads(m, frame)),
               ("refine_water", lambda m: refine_water(m, frame, water_prob)),
               ("refine_bridges", lambda m: refine_bridges(m, frame, bridge_prob))]
    if recovery:
        stages.append(("bridge_recovery", lambda m: bridge_recovery(m, frame)))
    return stages


def clean_mask(mask: DataFrame, frame, strict: bool = True, **options) -> DataFrame:
    """All stages: gap fill, roads, water, bridges, recovery."""
    return run_stages(mask, default_stages(frame, **options), strict)
