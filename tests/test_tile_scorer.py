"""Tiles made, scored and counted in their strip, against tiles gathered from pixels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridrun.functions import logits as L
from gridrun.operators import scoring as MODEL
from gridrun.operators.burn import box_layer, burn_boxes
from gridrun.operators.runs import decode
from gridrun.operators.strips import box_layer_of, lay_over
from gridrun.sources.fixtures import IMAGE_BANDS, image_bands


def test_image_bands(spark):
    rows = [(r, y, x, k) for r in (0, 5, 60000, -9) for y, x, k in ((0, 0, 0), (3, 200, 4), (255, 255, 1))]
    want = spark.createDataFrame(rows, "raster_id long, row int, col int, class_id int").selectExpr(*IMAGE_BANDS).collect()
    assert image_bands(*np.array(rows).T).tolist() == [list(r) for r in want]


@pytest.mark.parametrize("at_once", [500, 1_000_000])
def test_predicted_px(spark, monkeypatch, at_once):
    monkeypatch.setattr(MODEL, "PIXELS_AT_ONCE", at_once)
    rng = np.random.default_rng(2)
    boxes = [(int(rng.integers(1, 4)), int(rng.integers(0, 6)), *(int(v) for v in (*rng.integers(-5, 50, 2), *rng.integers(1, 20, 2)))) for _ in range(60)] + [(None, 1, 2, 2, 5, 5)]
    features = spark.createDataFrame(boxes, "raster_id long, class_id int, c0 int, r0 int, w int, h int")
    whole = box_layer_of(spark.createDataFrame([(k, 0, 49, 0, 43) for k in (1, 2, 2, 7)], "raster_id long, r0 int, r1 int, c0 int, c1 int"))
    runs = lay_over({"on": whole, "class_id": box_layer_of(burn_boxes(features, 44, 50), "class_id")}, under="on").drop("on").fillna(0, ["class_id"])
    z = MODEL.score_tiles(MODEL.image_tiles(decode(runs).selectExpr("raster_id", "row", "col", *IMAGE_BANDS), 16), MODEL.linear_scorer)
    want = z.select("raster_id", L.argmax(F.transform("z", lambda x: F.round(x, 9))).alias("pred")).groupBy("raster_id", "pred").agg(F.count("*").alias("px"))
    parts = MODEL.predicted_px(whole, box_layer(features, 44, 50), image_bands, 16, MODEL.linear_scorer, strip=32)
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "collect_list" not in plan
    got = parts.groupBy("raster_id", "pred").agg(F.sum("px").alias("px"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.agg(F.sum("px")).first()[0] == 3 * 44 * 50
