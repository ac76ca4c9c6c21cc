"""Steps that take many small groups in one call, next to plain pixels."""

import numpy as np
from pyspark.sql import functions as F

from gridrun.operators import morphology as MO
from gridrun.operators.burn import box_layer, burn_boxes
from gridrun.operators.catalog import mean_under_boxes
from gridrun.operators.components import component_stats, label_components, stats_of_boxes
from gridrun.operators.runs import decode
from gridrun.operators.strips import WEIGHT_AT_ONCE, _portions, box_layer_of, grouped, lay_over, spread

BOX = "raster_id long, feature_id long, class_id int, c0 int, r0 int, w int, h int"


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def boxes_of(spark, side, n, rasters, seed=1):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(int(rng.choice(rasters)), k, int(rng.integers(1, 5)), int(rng.integers(0, side - 4)), int(rng.integers(0, side - 4)),
                                   int(rng.integers(1, 20)), int(rng.integers(1, 20))) for k in range(n)], BOX)


def test_groups_are_whole_and_many_come_in_one_call(spark):
    """A call per group cost milliseconds each; a group larger than a batch must still come whole."""
    import pyarrow as pa

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        d = spark.range(400).select(F.when(F.col("id") < 35, F.lit(None)).when(F.col("id") < 90, F.lit(0)).otherwise(F.col("id") % 97).cast("long").alias("g"))

        def counted(t, starts):
            return pa.table({"g": t.column("g").take(pa.array(starts)), "n": np.diff(np.append(starts, t.num_rows)), "calls": np.append(1, np.zeros(len(starts) - 1, int))})

        got = grouped(d, ["g"], counted, "g long, n long, calls long").collect()
        want = {r.g: r["count"] for r in d.groupBy("g").count().collect()}
        assert {r.g: r.n for r in got} == want and len(got) == len(want)
        assert sum(r.calls for r in got) < len(want) / 1.5
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    t = pa.table({"g": [1, 1, 2, 3, 3]})
    parts = list(_portions(t, ["g"], lambda t: np.full(t.num_rows, WEIGHT_AT_ONCE // 2)))
    assert len(parts) > 1 and sum(len(s) for _, s in parts) == 3 and pa.concat_tables(p for p, _ in parts).equals(t)


def test_kernels_on_rasters_of_several_sizes_in_one_call(spark, make, dense):
    rng = np.random.default_rng(7)
    masks = {k: (rng.random((s, s)) < 0.4).astype(int) for k, s in ((1, 20), (2, 20), (3, 33), (4, 9))}
    runs = None
    for k, m in masks.items():
        d = make(m, k).drop("class_id").withColumn("width", F.lit(m.shape[1])).withColumn("height", F.lit(m.shape[0]))
        runs = d if runs is None else runs.unionByName(d)
    for erode in (False, True):
        every = spread(runs.coalesce(1), MO.disc(2), 8, erode=erode)
        assert "FlatMapGroupsInArrow" not in every._jdf.queryExecution().executedPlan().toString()
        for k, m in masks.items():
            alone = spread(runs.filter(F.col("raster_id") == k), MO.disc(2), 64, erode=erode)
            assert (dense(every.filter(F.col("raster_id") == k), m.shape) == dense(alone, m.shape)).all()


def test_segments_under_a_layer(spark, make):
    rng = np.random.default_rng(3)
    a, b = make(rng.integers(0, 2, (12, 12))), make(rng.integers(0, 3, (12, 12)))
    layers = {"a": box_layer_of(a), "b": box_layer_of(b, "class_id")}
    cols = ("raster_id", "row", "c0", "c1", "a", "b")
    assert rows(lay_over(layers, under="a"), *cols) == rows(lay_over(layers).filter("a is not null"), *cols)


def test_component_sums_of_boxes_need_no_shuffle_of_runs(spark):
    boxes = boxes_of(spark, 60, 150, [1, 2, 3]).unionByName(spark.createDataFrame([(1, 900, 2, 10, 5, 2, 40), (1, 901, 2, 12, 45, 2, 10)], BOX))
    for strip, connectivity in ((8, 8), (8, 4), (16, 8), (64, 8)):
        want = component_stats(label_components(burn_boxes(boxes, 60, 60), (60, 60), connectivity=connectivity, tile=16))
        got = stats_of_boxes(box_layer(boxes, 60, 60), (60, 60), connectivity=connectivity, strip=strip)
        assert got.columns == want.columns and got.dtypes == want.dtypes
        assert rows(got, "*") == rows(want, "*")


def test_means_under_boxes(spark):
    boxes = boxes_of(spark, 70, 60, [1, 2])
    truth = burn_boxes(boxes, 64, 64)
    coloured = lambda runs: decode(runs).withColumn("v", F.expr("(row * 7 + col * 3 + class_id * 11 + raster_id) % 50"))
    got = mean_under_boxes(boxes, truth, coloured, {"m": "v"}, (64, 64), cell=8)
    grid = {(r.raster_id, r.row, r.col): r.v for r in coloured(truth).collect()}
    want = {}
    for b in boxes.collect():
        px = [v for r in range(b.r0, min(b.r0 + b.h, 64)) for c in range(b.c0, min(b.c0 + b.w, 64)) if (v := grid.get((b.raster_id, r, c))) is not None]
        if px:
            want[b.raster_id, b.feature_id] = sum(px) / len(px)
    assert {(r.raster_id, r.feature_id): round(r.m, 9) for r in got.collect()} == {k: round(v, 9) for k, v in want.items()}
