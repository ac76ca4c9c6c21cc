"""Rings burned strip by strip against scanning and burning apart."""

import numpy as np
import pytest

from gridrun.operators import burn
from gridrun.operators.burn import burn_boxes, burn_rings, burn_runs, recoded_boxes, scan_rings
from gridrun.operators.runs import decode, encode

RING = "raster_id long, feature_id long, class_id int, rings array<array<struct<x:double,y:double>>>"
DIMS = "raster_id long, gt_a double, gt_c double, gt_e double, gt_f double, width int, height int"


def rows(df):
    return sorted((tuple(r) for r in df.select("raster_id", "row", "c0", "c1", "class_id").collect()), key=repr)


def shape(rng, closed):
    if rng.random() < 0.4:      # a box, at times on pixel centres
        x, y, w, h = (float(v) / 2 for v in rng.integers(-20, 120, 2).tolist() + rng.integers(1, 80, 2).tolist())
        ring = [(x, -y), (x + w, -y), (x + w, -y - h), (x, -y - h)]
    else:
        ring = [(float(x), -float(y)) for x, y in rng.uniform(-10, 70, (int(rng.integers(3, 9)), 2))]
    return [*ring, ring[0]] if closed else ring


@pytest.mark.parametrize("strip", [16, 512])
def test_burn_rings(spark, strip):
    rng = np.random.default_rng(strip)
    features = [(int(rng.integers(1, 4)), i, int(rng.integers(0, 6)), [shape(rng, rng.random() < 0.9) for _ in range(int(rng.integers(1, 4)))]) for i in range(80)]
    features += [*features[:10], (1, None, 2, [shape(rng, True)]), (1, None, 2, [shape(rng, True)]), (None, 3, 2, [shape(rng, True)]), (9, 3, 2, [shape(rng, True)])]
    features += [(2, 7000, 3, []), (2, 7001, 3, None), (2, 7002, None, [shape(rng, True)]), (2, 7003, 3, [[(1.0, -1.0)], [(None, -1.0), (5.0, None), (9.0, -30.0)]])]
    features += [(3, 8000, 3, [shape(rng, False)]), (3, 8000, 3, [shape(rng, True)]), (3, 8000, 3, [shape(rng, False)])]
    f = spark.createDataFrame(features, RING)
    catalog = spark.createDataFrame([(1, 1.0, 0.0, -1.0, 0.0, 60, 60), (2, 0.5, -3.0, -0.5, 2.0, 130, 100), (3, 1.0, 0.0, -1.0, 0.0, 60, 40)], DIMS)
    assert rows(burn_rings(f, catalog, strip=strip)) == rows(burn_runs(scan_rings(f, catalog)))
    twice = catalog.unionByName(catalog.filter("raster_id = 2"))
    assert rows(burn_rings(f, twice, strip=strip)) == rows(burn_runs(scan_rings(f, twice)))
    assert burn_rings(f.limit(0), catalog).count() == 0


def test_rings_cross_one_shuffle(spark):
    f = spark.createDataFrame([(1, 1, 2, [[(1.0, -1.0), (9.0, -1.0), (9.0, -9.0), (1.0, -9.0), (1.0, -1.0)]])], RING)
    catalog = spark.createDataFrame([(1, 1.0, 0.0, -1.0, 0.0, 60, 60)], DIMS)
    plan = burn_rings(f, catalog)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan


def test_recoded_boxes(spark, monkeypatch):
    rng = np.random.default_rng(4)
    boxes = [(int(rng.integers(1, 4)) if i % 9 else None, int(rng.integers(0, 6)), *(int(v) for v in (*rng.integers(-5, 60, 2), *rng.integers(1, 30, 2)))) for i in range(200)]
    df = spark.createDataFrame(boxes, "raster_id long, class_id int, c0 int, r0 int, w int, h int")
    want = encode(decode(burn_boxes(df, 60, 50)))
    assert rows(recoded_boxes(df, 60, 50, strip=16)) == rows(want) == rows(recoded_boxes(df, 60, 50))
    plan = recoded_boxes(df, 60, 50)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan
    monkeypatch.setattr(burn, "PIXELS_AT_ONCE", 7)
    line, c0, c1 = np.array([0, 0, 0, 1, 3, 3]), np.array([2, 5, 9, 0, 4, 1]), np.array([4, 5, 20, 8, 6, 2])
    assert [x.tolist() for x in burn._coded(line, c0, c1)] == [[0, 0, 1, 3, 3], [2, 9, 0, 1, 4], [5, 20, 8, 2, 6]]
