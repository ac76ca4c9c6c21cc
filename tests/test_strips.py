"""Layers burned and laid over each other in strips of rows, next to the run algebra and to pixels."""

from gridrun.operators.burn import box_layer, box_runs, burn_boxes, burn_runs
from gridrun.operators.metrics import confusion, confusion_of
from gridrun.operators.strips import lay_over

BOX = "raster_id long, class_id int, c0 int, r0 int, w int, h int"
BOXES = [(1, 3, 2, 500, 10, 30), (1, 1, 5, 505, 4, 40), (1, 3, 12, 500, 3, 30), (1, 3, 2, 500, 10, 30), (2, 4, -3, 1020, 8, 20),
         (2, 2, 60, 0, 9, 2), (None, 2, 1, 1, 2, 2), (2, 9, 0, 0, 5, 5), (2, None, 0, 0, 5, 5), (3, 1, None, 3, 4, 4)]
MOVED = [(1, 3, 3, 500, 10, 30), (2, 4, 0, 1000, 8, 24), (4, 2, 0, 0, 64, 1)]


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_burned_strips_equal_burned_runs(spark):
    boxes = spark.createDataFrame(BOXES, BOX)
    got, want = burn_boxes(boxes, 64, 1024), burn_runs(box_runs(boxes, 64, 1024))
    cols = ("raster_id", "row", "c0", "c1", "class_id")
    assert rows(got, *cols) == rows(want, *cols)


def test_boxes_are_shuffled_not_the_ends_of_their_runs(spark):
    """The shuffle writes a row per box and strip; burning runs wrote two per row of a box."""
    burned = burn_boxes(spark.createDataFrame([(1, 1, 0, 0, 5, 400)] * 50, BOX), 64, 512)
    plan = burned._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "sequence(0, " not in plan.split("Exchange hashpartitioning")[0]
    assert burned.count() == 400


def test_pairs_of_burned_layers_give_the_confusion_of_masks(spark):
    truth, pred = spark.createDataFrame(BOXES[:6], BOX), spark.createDataFrame(MOVED, BOX)
    catalog = spark.createDataFrame([(k, 64, 1024) for k in (1, 2, 3, 4)], "raster_id long, width int, height int")
    layers = {"gt": box_layer(truth, 64, 1024), "pred": box_layer(pred, 64, 1024)}
    got = confusion_of(lay_over(layers, ("gt", "pred")).fillna(0, ["gt", "pred"]), catalog)
    want = confusion(burn_runs(box_runs(truth, 64, 1024)), burn_runs(box_runs(pred, 64, 1024)), catalog)
    cols = ("raster_id", "gt", "pred", "n")
    assert rows(got, *cols) == rows(want, *cols)


def test_values_of_any_type_are_laid_over(spark):
    a = spark.createDataFrame([(1, 0, 1, 0, 9, 0.5), (1, 0, 0, 10, 19, 0.5), (1, 0, 0, 20, 29, None)], "raster_id long, r0 int, r1 int, c0 int, c1 int, value double")
    b = spark.createDataFrame([(1, 0, 0, 5, 24, 1 << 40)], "raster_id long, r0 int, r1 int, c0 int, c1 int, value long")
    got = rows(lay_over({"a": a, "b": b}, strip=1), "row", "c0", "c1", "a", "b")
    big = 1 << 40
    assert got == sorted([(0, 0, 4, 0.5, None), (0, 5, 19, 0.5, big), (0, 20, 24, None, big), (1, 0, 9, 0.5, None)], key=repr)


def test_strips_without_a_box_of_a_known_class_give_no_rows(spark):
    assert burn_boxes(spark.createDataFrame(BOXES[7:9], BOX), 64, 1024).count() == 0


def test_zones_over_blocks_of_confidence_equal_zones_over_its_runs(spark):
    """Confidence goes into the zone table as blocks of rows; as runs it was one row per block and row."""
    from gridrun.plans.spatial import zone_table

    blocks = spark.createDataFrame([(1, 0, 15, 0, 15, 0.25), (1, 0, 15, 16, 31, 0.75), (1, 16, 31, 0, 31, 0.5)], "raster_id long, r0 int, r1 int, c0 int, c1 int, conf double")
    runs = blocks.selectExpr("raster_id", "explode(sequence(r0, r1)) as row", "c0", "c1", "conf")
    zone = spark.createDataFrame([(1, r, 8, 23, 7) for r in range(8, 24)], "raster_id long, row int, c0 int, c1 int, comp_id long")
    near = spark.createDataFrame([(1, 8, 0, 11)], "raster_id long, row int, c0 int, c1 int")
    got, want = (zone_table(zone, c, {"near": near}, 1).first().asDict() for c in (blocks, runs))
    assert got == want and (got["area_px"], got["mean_conf"], got["near"]) == (256, 0.5, 4)


def random_mask(side, classes, seed):
    import numpy as np

    rng = np.random.default_rng(seed)
    return np.kron(rng.integers(0, classes + 1, (side // 4, side // 4)), np.ones((4, 4), int)) * (rng.random((side, side)) < 0.9)


def test_kernels_reach_across_strips(make, dense):
    """Dilation and erosion of strips of 7 rows, against pixels; the shuffle takes a run once per strip, not once per kernel row."""
    import numpy as np
    from pyspark.sql import functions as F

    from gridrun.operators import morphology as MO
    from gridrun.operators.strips import spread

    m = random_mask(40, 1, 3) > 0
    m[5:30, 10:35] = True
    runs = make(m.astype(int)).drop("class_id").withColumn("width", F.lit(40)).withColumn("height", F.lit(40))
    for kernel in (MO.rect(5, 3), MO.disc(6), MO.rect(3, 21)):
        hit, all_on = np.zeros_like(m), np.ones_like(m)
        for dy, hw in kernel:
            for dx in range(-hw, hw + 1):
                for r in range(40):
                    for c in range(40):
                        if 0 <= r + dy < 40 and 0 <= c + dx < 40:
                            hit[r, c] |= m[r + dy, c + dx]
                            all_on[r, c] &= m[r + dy, c + dx]
        assert (dense(spread(runs, kernel, 7), m.shape) == hit).all()
        assert (dense(spread(runs, kernel, 7, erode=True), m.shape) == all_on).all()
    plan = MO.dilate(runs, MO.disc(6), (40, 40))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan


def test_component_sums_of_tiles_equal_those_of_labelled_runs(make):
    """Only sums and border runs leave a tile; the labelled runs were stored and joined with their roots."""
    from gridrun.operators.components import component_stats, label_components, stats_of_runs

    runs = make(random_mask(48, 2, 5)).unionByName(make(random_mask(48, 3, 6), 2))
    for connectivity in (8, 4):
        want = component_stats(label_components(runs, (48, 48), connectivity=connectivity, tile=16))
        got = stats_of_runs(runs, (48, 48), connectivity=connectivity, tile=16)
        assert got.columns == want.columns and got.dtypes == want.dtypes
        assert rows(got, "*") == rows(want, "*")
    assert rows(stats_of_runs(runs, (48, 48)), "*") == rows(component_stats(label_components(runs, (48, 48))), "*")


def test_repainting_needs_no_window(make, dense):
    import numpy as np

    from gridrun.operators.runs import repaint

    m = random_mask(24, 3, 8)
    new = random_mask(24, 1, 9) > 0
    got = repaint(make(m), 2, make(new.astype(int)).drop("class_id"))
    assert (dense(got, m.shape, "class_id") == np.where(new, 2, np.where(m == 2, 0, m))).all()
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
