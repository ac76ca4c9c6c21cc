import numpy as np
from pyspark.sql import functions as F

from gridrun.operators import augment as AU
from gridrun.operators.runs import decode

SCHEMA = "raster_id long, row int, col int, red int"


def scene():
    """Three rasters of 32 px: two full cells and one at the limit in raster 1, none in 2, one in 3."""
    masks = {k: np.zeros((32, 32), int) for k in (1, 2, 3)}
    masks[1][0:8, 0:7] = 2      # 56 pixels: in the pool
    masks[1][16:21, 0:10] = 2   # 50 pixels: not more than 50
    masks[1][5:25, 18:22] = 2   # 80 pixels over two cells: 44 and 36
    masks[2][3:20, 3:20] = 1
    masks[3][16:32, 16:32] = 2
    return masks


def test_pool_and_paste_equal_a_dense_paste(spark, make, dense):
    masks = scene()
    mask = make(masks[1], 1).unionByName(make(masks[2], 2)).unionByName(make(masks[3], 3))
    pool = AU.crop_pool(mask, 2, size=16)
    crops = {(r.crop, r.src, r.top, r.left) for r in pool.collect()}
    assert crops == {(1, 1, 0, 0), (2, 3, 16, 16)}
    catalog = spark.createDataFrame([(k, 32, 32) for k in masks], "raster_id long, height int, width int")
    draws = AU.draw_crops(pool, catalog, size=16, prob=1.0)
    placed = {r.raster_id: r for r in draws.collect()}
    assert set(placed) == {1, 2, 3} and all(0 <= r.y <= 16 and 0 <= r.x <= 16 for r in placed.values())
    pasted = AU.pasted_runs(pool, draws)
    image = spark.createDataFrame([(k, r, c, k * 10000 + r * 100 + c) for k in masks for r in range(32) for c in range(32)], SCHEMA)
    bands = {k: np.zeros((32, 32), int) for k in masks}
    for r in AU.paste_bands(image, pasted, ["red"]).collect():
        bands[r.raster_id][r.row, r.col] = r.red
    got = AU.paste_mask(mask, pasted, 2)
    for k, m in masks.items():
        src, top, left = {c: rest for c, *rest in crops}[placed[k].crop]
        want, red = m.copy(), k * 10000 + np.arange(32)[:, None] * 100 + np.arange(32)[None, :]
        for r, c in np.argwhere(masks[src][top:top + 16, left:left + 16] == 2):
            want[placed[k].y + r, placed[k].x + c] = 2
            red[placed[k].y + r, placed[k].x + c] = src * 10000 + (top + r) * 100 + left + c
        assert (dense(got.filter(F.col("raster_id") == k), (32, 32), "class_id") == want).all()
        assert (bands[k] == red).all()


def test_empty_pool_pastes_nothing(spark, make):
    mask = make([[1, 2, 2, 0]])
    pool = AU.crop_pool(mask, 2, size=16)
    catalog = spark.createDataFrame([(1, 32, 32)], "raster_id long, height int, width int")
    draws = AU.draw_crops(pool, catalog, size=16, prob=1.0)
    assert draws.count() == 0
    assert decode(AU.paste_mask(mask, AU.pasted_runs(pool, draws), 2)).count() == 3


def test_share_of_rasters_follows_prob(spark, make):
    pool = AU.crop_pool(make(np.full((16, 16), 2)), 2, size=16)
    catalog = spark.range(2000).selectExpr("id as raster_id", "32 as height", "32 as width")
    n = AU.draw_crops(pool, catalog, size=16, prob=0.3).count()
    assert 520 < n < 680
    assert AU.draw_crops(pool, catalog, size=16, prob=0.0).count() == 0


def test_paste_of_runs_equals_the_paste_of_pixels(spark, make):
    """Rasters with and without a paste, source pixels of two classes and some that the image lacks, one paste twice."""
    masks = scene()
    mask = make(masks[1], 1).unionByName(make(masks[2], 2)).unionByName(make(masks[3], 3))
    pasted = spark.createDataFrame(
        [(2, 4, 10, 19, 1, 1, 8), (2, 4, 10, 19, 1, 1, 8), (2, 5, 0, 6, 2, 1, -3), (3, 0, 0, 31, 3, -16, 0), (3, 20, 1, 9, 1, 15, 1), (1, 30, 5, 6, 2, 25, 0), (None, 1, 1, 5, 1, 0, 0)],
        "raster_id long, row int, c0 int, c1 int, src long, dr int, dc int")
    pixels = lambda d: decode(d).withColumn("red", F.expr("raster_id * 100000 + row * 1000 + col * 10 + class_id"))
    after = AU.paste_mask(mask, pasted, 2)
    want = decode(after).join(AU.paste_bands(pixels(mask), pasted, ["red"]), ["raster_id", "row", "col"]).select("raster_id", "row", "col", "class_id", "red")
    got = AU.paste_bands(mask, pasted, ["red"], pixels, after)
    assert got.columns == want.columns
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(map(tuple, want.collect())) and len(rows) > len(set(rows))
