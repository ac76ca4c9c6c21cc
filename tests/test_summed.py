"""Summed areas against counting, stored windows, wide rasters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridrun.operators.summed import box_class_px
from gridrun.sources import sinks as SI

SIDES = "raster_id long, height int, width int"


@pytest.mark.parametrize("cell", [8, 16])
def test_box_class_px(spark, make, cell):
    rng = np.random.default_rng(cell)
    h, w, patch = 50, 70, 13
    masks = {1: rng.integers(0, 5, (h, w)) * (rng.random((h, w)) < 0.6), 2: np.zeros((h, w), int)}
    runs = make(masks[1], 1)
    places = [(k, y, x, f"{k}-{y}-{x}") for k in (1, 2) for y in range(0, h - patch + 1, 3) for x in (*range(0, w - patch + 1, 5), w - patch)]
    boxes = spark.createDataFrame(sorted(set(places)), "raster_id long, y int, x int, tag string")
    got = box_class_px(runs, spark.createDataFrame([(1, h, w), (2, h, w)], SIDES), boxes, patch, cell).collect()
    assert len(got) == len(set(places))
    for r in got:
        cut = masks[r.raster_id][r.y : r.y + patch, r.x : r.x + patch]
        assert [r[f"px{k}"] for k in range(5)] == [int((cut == k).sum()) for k in range(5)] and r.tag == f"{r.raster_id}-{r.y}-{r.x}"


def test_box_class_px_of_boxes_from_the_same_runs(spark, make):
    mask = np.zeros((40, 40), int)
    mask[3:9, 4:20] = 2
    runs = make(mask)
    boxes = runs.select("raster_id", F.col("row").alias("y"), F.col("c0").alias("x")).distinct()
    got = box_class_px(runs, spark.createDataFrame([(1, 40, 40)], SIDES), boxes, 10, 16).collect()
    assert sorted((r.y, r.px2) for r in got) == [(y, (9 - y) * 10) for y in range(3, 9)]
    assert box_class_px(runs.limit(0), spark.createDataFrame([(1, 40, 40)], SIDES), boxes.limit(0), 10, 16).count() == 0


def test_windows_of_a_stored_mask_prune(spark, make, tmp_path):
    rng = np.random.default_rng(4)
    mask = rng.integers(0, 3, (256, 40))
    path = str(tmp_path / "mask")
    SI.write_mask(make(mask), path, strip=32)
    read = lambda *w: SI.read_window(spark, path, *w)
    files = lambda df: df.select(F.input_file_name().alias("f")).distinct().count()
    for r0, c0, h, w in ((0, 0, 256, 40), (31, 5, 2, 7), (64, 0, 32, 40), (250, 38, 100, 100), (300, 0, 5, 5), (10, 10, 0, 5)):
        seen = np.zeros_like(mask)
        for r in read(r0, c0, h, w).collect():
            seen[r.row, r.c0 : r.c1 + 1] = r.class_id
        want = np.zeros_like(mask)
        want[r0 : r0 + h, c0 : c0 + w] = mask[r0 : r0 + h, c0 : c0 + w]
        assert (seen == want).all()
    plan = read(64, 0, 32, 40)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(strip_32" in plan and "PushedFilters: [" in plan and "GreaterThanOrEqual(row,64)" in plan
    assert 0 < files(read(64, 0, 32, 40)) < files(spark.read.parquet(path))
    assert read(0, 0, 256, 40).columns == SI.read_mask(spark, path).columns and SI.read_window(spark, path, 0, 0, 256, 40, rasters=(9,)).count() == 0
