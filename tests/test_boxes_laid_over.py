"""Queries that lay burned boxes over each other in strips, against runs laid over each other."""

import numpy as np
from pyspark.sql import functions as F

from gridrun.operators.burn import box_layer, burn_boxes
from gridrun.operators.runs import run_len, subtract, subtract_boxes
from gridrun.plans import spatial as SP

SIDE = 64


def boxes(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(int(rng.integers(1, 4)) if i % 13 else None, int(rng.integers(0, 6)), *(int(v) for v in (*rng.integers(-5, 70, 2), *rng.integers(1, 20, 2)))) for i in range(120)]
    return spark.createDataFrame(rows, "raster_id long, class_id int, c0 int, r0 int, w int, h int")


def blocks(spark):
    rows = [(k, r, r + 15, c, c + 15, 0.5 + (r * 3 + c * 7 + k) % 11 / 20) for k in (1, 2, 4) for r in range(0, SIDE, 16) for c in range(0, SIDE, 16)]
    b = spark.createDataFrame(rows, "raster_id long, r0 int, r1 int, c0 int, c1 int, conf double")
    return b, b.select("raster_id", F.explode(F.sequence("r0", "r1")).alias("row"), "c0", "c1", "conf")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_subtract_boxes(spark):
    a, b = boxes(spark, 1), boxes(spark, 2)
    per = lambda d: of(d.groupBy("raster_id", "row").agg(F.sum(run_len()).alias("px"), F.sum((F.col("c0") + F.col("c1")) * run_len()).alias("at")))
    got = subtract_boxes(box_layer(a, SIDE, SIDE), box_layer(b, SIDE, SIDE))
    assert plan(got).count("Exchange") == 1 and "Window" not in plan(got) and got.columns == ["raster_id", "row", "c0", "c1"]
    assert per(got) == per(subtract(burn_boxes(a, SIDE, SIDE), burn_boxes(b, SIDE, SIDE)))


def test_explainability_of_boxes(spark):
    features, (conf, runs) = boxes(spark, 3), blocks(spark)
    catalog = spark.createDataFrame([(k, SIDE, SIDE) for k in (1, 2, 3, 4)], "raster_id long, width int, height int")
    got = SP.explainability(box_layer(features, SIDE, SIDE), conf, catalog)
    text = plan(got)
    assert of(got) == of(SP.explainability(burn_boxes(features, SIDE, SIDE), runs, catalog)) and got.count() == 3
    assert text.count("MapInArrow") == 1 and "Window" not in text
    assert of(SP.confidence_coverage(conf)) == of(SP.confidence_coverage(runs))


def test_nearness_lays_strips_over_each_other(spark, make):
    mask = np.zeros((SIDE, SIDE), int)
    mask[5, 3:30], mask[10:20, 8:40], mask[50:60, 40:50], mask[48:50, 2:6] = 1, 3, 3, 4
    got = SP.builtup_nearness(make(mask), 5.0, (SIDE, SIDE))
    near = lambda k, r: np.array([[any(abs(y - a) <= r and abs(x - b) <= round((r * r - (y - a) ** 2) ** 0.5) for a, b in np.argwhere(mask == k)) for x in range(SIDE)] for y in range(SIDE)])
    assert "Window" not in plan(got)
    r = got.first()
    assert r.bu_px == 420 and r.near_road_px == int((near(1, 10) & (mask == 3)).sum())
