"""Patch catalog against counting pixel by pixel, and what crosses the shuffle for it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridrun.operators import ranking as RK
from gridrun.operators import sampling as SA
from gridrun.operators.catalog import patch_positions
from gridrun.operators.patches import class_px, patch_catalog
from gridrun.plans import sparse as SPX

BOX = "raster_id long, feature_id long, class_id int, c0 int, r0 int, w int, h int"
DIMS = "raster_id long, height int, width int, split string"
H, W, PATCH = 150, 90, 16


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def boxes(rng, n, raster):
    one = lambda hi: rng.integers(1, hi, n)
    at = zip(rng.integers(1, 5, n), rng.integers(0, W + 10, n), rng.integers(0, H + 10, n), one(30), one(30), strict=True)
    return [(raster, i, *(int(v) for v in b)) for i, b in enumerate(at)]


def painted(rows):
    """Burned pixels, the lowest class first; a box below the frame fills the rows from the last one to its own top."""
    mask = np.zeros((H + 60, W), int)
    for _, _, k, c0, r0, w, h in sorted(rows, key=lambda b: -b[2]):
        top, bottom = max(r0, 0), min(r0 + h - 1, H - 1)
        mask[min(top, bottom) : max(top, bottom) + 1, max(c0, 0) : min(c0 + w, W)] = k
    return mask


@pytest.mark.parametrize("strip", [32, 64])
def test_patch_catalog(spark, strip):
    rng = np.random.default_rng(strip)
    rows = {1: boxes(rng, 40, 1), 2: boxes(rng, 3000, 2), 3: [(3, 1, 1, 4, 4, 20, 20)], 4: boxes(rng, 5, 4)}
    features = spark.createDataFrame([b for k in rows for b in rows[k]] + rows[1][:5] + [(None, 1, 2, 5, 5, 5, 5)], BOX)
    catalog = spark.createDataFrame([(1, H, W, "train"), (2, H, W, "val"), (2, H, W, "val"), (3, H, W, "train"), (None, H, W, "train")], DIMS)
    got = patch_catalog(features, catalog, (W, H), 2, PATCH, 8, ("split",), strip)
    assert got.columns == ["raster_id", "y", "x", "px1", "px2", "px3", "px4", "px0", "split"]
    masks = {k: painted(rows[k]) for k in (1, 2, 3)}
    want = []
    for p in patch_positions(features.filter("class_id = 2"), catalog, PATCH, 8).collect():
        cut = masks[p.raster_id][p.y : p.y + PATCH, p.x : p.x + PATCH]
        n = [int((cut == k).sum()) for k in (1, 2, 3, 4, 0)]
        want += [(p.raster_id, p.y, p.x, *n, "train" if p.raster_id == 1 else "val")] * (2 if p.raster_id == 2 else 1) * (n[1] > 0)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_many_blocks_under_many_patches():
    """Cells that hold many blocks and patches are summed up as images; the others pair by pair."""
    rng = np.random.default_rng(1)
    mask = np.zeros((64, 64), int)
    mask[:32, :40] = rng.integers(0, 5, (32, 40))
    mask[50:53, 3:60] = 2
    at = np.argwhere(mask > 0)
    place = np.array([(y, x) for y in range(49) for x in range(49)])
    got = class_px(mask[mask > 0], at[:, 0], at[:, 0], at[:, 1], at[:, 1], place[:, 0], place[:, 1], 16)
    want = [[int((mask[y : y + 16, x : x + 16] == k).sum()) for k in range(1, 5)] for y, x in place]
    assert (got[:, 1:] == want).all()


def test_null_and_odd_boxes_as_positions(spark):
    rows = [(1, 1, 2, None, 5, 9, 4), (1, 2, 2, 5, None, 9, 4), (1, 3, 2, 5, 5, None, 4), (1, 4, 2, 60, 140, 40, 40), (1, 5, 2, 5, 20, 70, 3), (1, 6, 2, 200, 20, 5, 5), (1, 7, 2, 2, 300, 5, 5)]
    catalog = spark.createDataFrame([(1, H, W, "train")], DIMS)
    for b in rows:
        f = spark.createDataFrame([b, (1, 0, 2, 0, 0, W, H)], BOX)      # all pixels, so that every place shows one
        got = patch_catalog(f, catalog, (W, H), 2, PATCH, 8, strip=32)
        assert sorted((r.y, r.x) for r in got.collect()) == sorted((r.y, r.x) for r in patch_positions(f, catalog, PATCH, 8).collect())


def test_patches_shuffle_boxes_only(spark):
    rows = boxes(np.random.default_rng(3), 50, 1)
    df = patch_catalog(spark.createDataFrame(rows, BOX), spark.createDataFrame([(1, H, W, "train")], DIMS), (W, H), 2, PATCH, 8, ("split",))
    assert plan(df).count("MapInArrow") == 1 and "CoGroup" not in plan(df) and plan(df).count("Window") == 0


def test_numbered_rows_are_ranked_where_they_were_sorted(spark):
    rows = [(k % 3 if k % 10 else None, k * 7 % 101) for k in range(400)]
    df = spark.createDataFrame(rows, "k int, v int").withColumn("id", F.monotonically_increasing_id())
    every = RK.number_rows(df, [], ["-v", "id"], "n", chunks=5)
    assert "SortMergeJoin" not in plan(every) and "Window [row_number" not in plan(every)
    got = every.orderBy("n").collect()
    assert [r.n for r in got] == list(range(1, 401)) and [(-r.v, r.id) for r in got] == sorted((-r.v, r.id) for r in got)
    per = RK.number_rows(df, ["k"], ["v", "id"], chunks=5, few=True)
    assert "SortMergeJoin" not in plan(per)
    by = {}
    for r in per.collect():
        by.setdefault(r.k, []).append((r.rn, r.v, r.id))
    assert set(by) == {None, 0, 1, 2} and all(sorted(x) == [(i, *y) for i, y in enumerate(sorted(z[1:] for z in x), 1)] for x in by.values())


def test_draws_and_shares_read_their_rows_once(spark):
    """The order, its total and the share come from the stored order; nothing is made from the rows a second time."""
    seen = spark.sparkContext.accumulator(0)

    def count(parts):
        for b in parts:
            seen.add(b.num_rows)
            yield b

    rows = [(i // 10, i % 10, 0, i * 31 % 97, 1.0 / (1 + i % 3)) for i in range(100)]
    df = spark.createDataFrame(rows, "raster_id int, y int, x int, px2 int, weight double").mapInArrow(count, "raster_id int, y int, x int, px2 int, weight double")
    assert SA.weighted_draws(df, "weight", ["raster_id", "y", "x"]).agg(F.sum("draws")).first()[0] == 100
    assert seen.value <= 200      # the bounds of the order, then the rows
    assert SPX.top_share(df, 16, 2).count() == 50 and SPX.curriculum(df).count() == 133
    assert seen.value <= 600
