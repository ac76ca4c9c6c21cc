"""Run algebra, morphology, components and proximity against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridrun.operators import components as C
from gridrun.operators import morphology as MO
from gridrun.operators import postprocess as PP
from gridrun.operators import proximity as P
from gridrun.operators import runs as R
from gridrun.operators import texture as TX

N = 40
rng = np.random.default_rng(5)
MASK = (rng.random((N, N)) < 0.42).astype(int)
BLOBS = np.zeros((N, N), int)
for _ in range(14):
    y, x = rng.integers(0, N, 2)
    h, w = rng.integers(2, 9, 2)
    BLOBS[y:y + h, x:x + w] = rng.integers(1, 5)


def dil(m, kernel):
    out = np.zeros_like(m)
    for y, x in zip(*np.nonzero(m)):
        for dy, hw in kernel:
            if 0 <= y + dy < m.shape[0]:
                out[y + dy, max(0, x - hw):x + hw + 1] = 1
    return out


def ero(m, kernel):
    out = np.zeros_like(m)
    for y in range(m.shape[0]):
        for x in range(m.shape[1]):
            out[y, x] = all(m[y + dy, max(0, x - hw):x + hw + 1].all() for dy, hw in kernel if 0 <= y + dy < m.shape[0])
    return out


def label(m, conn=8):
    """Breadth-first labels: first pixel id row*N+col."""
    lab = -np.ones_like(m)
    for y in range(m.shape[0]):
        for x in range(m.shape[1]):
            if not m[y, x] or lab[y, x] >= 0:
                continue
            lab[y, x], todo = y * m.shape[1] + x, [(y, x)]
            while todo:
                a, b = todo.pop()
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        if conn == 4 and dy and dx:
                            continue
                        p, q = a + dy, b + dx
                        if 0 <= p < m.shape[0] and 0 <= q < m.shape[1] and m[p, q] == m[y, x] and lab[p, q] < 0:
                            lab[p, q] = lab[y, x]
                            todo.append((p, q))
    return lab


@pytest.mark.parametrize("kernel", [MO.rect(5, 3), MO.rect(3, 19), MO.disc(4)])
def test_dilate_erode(make, dense, kernel):
    df = make(MASK).drop("class_id")
    assert (dense(MO.dilate(df, kernel, (N, N)), MASK.shape) == dil(MASK, kernel)).all()
    big = dil(MASK, MO.rect(3, 3))
    got = dense(MO.erode(make(big).drop("class_id"), kernel, (N, N)), MASK.shape)
    assert (got == ero(big, kernel)).all()


def test_overlay_and_sets(make, dense):
    a, b = (MASK > 0).astype(int), (BLOBS > 0).astype(int)
    da, db = make(a).drop("class_id"), make(b).drop("class_id")
    assert (dense(R.intersect(da, db), a.shape) == (a & b)).all()
    assert (dense(R.subtract(da, db), a.shape) == (a & (1 - b))).all()
    assert (dense(R.merge_runs(da.unionByName(db)), a.shape) == (a | b)).all()


@pytest.mark.parametrize("tile,conn", [(512, 8), (16, 8), (7, 8), (16, 4)])
def test_components_tiled(make, dense, tile, conn):
    """Cutting the raster into tiles must not change any label."""
    got = C.label_components(make(BLOBS), (N, N), connectivity=conn, tile=tile)
    out = -np.ones_like(BLOBS)
    for r in got.collect():
        out[r["row"], r["c0"]:r["c1"] + 1] = r["comp_id"]
    assert (out == label(BLOBS, conn)).all()


def test_components_long_snake(make):
    """One component winding through many tiles needs several merge rounds."""
    m = np.zeros((N, N), int)
    m[::2, :] = 1
    for r in range(1, N, 2):
        m[r, -1 if (r // 2) % 2 == 0 else 0] = 1
    got = C.label_components(make(m), (N, N), tile=8).select("comp_id").distinct().collect()
    assert [r[0] for r in got] == [0]


@pytest.mark.parametrize("radius,tile", [(4, 16), (9, 1024)])
def test_near_pixels(make, dense, radius, tile):
    t, s = (BLOBS == 3).astype(int), (MASK * (rng.random((N, N)) < 0.05)).astype(int)
    got = dense(P.near_pixels(make(t).drop("class_id"), make(s).drop("class_id"), radius, tile), t.shape)
    assert (got == (t & dil(s, MO.disc(radius)))).all()


def test_thin_tiled_equals_whole(make, dense):
    m = dil((BLOBS == 1).astype(int), MO.rect(7, 7))
    whole = dense(TX.thin(make(m).drop("class_id"), (N, N)), m.shape)
    tiled = dense(TX.thin(make(m).drop("class_id"), (N, N), tile=16, halo=4), m.shape)
    assert (whole == tiled).all() and 0 < whole.sum() < m.sum()


def test_distance_inside(make):
    m = dil((BLOBS == 4).astype(int), MO.rect(5, 5))
    bg = np.argwhere(m == 0)
    for r in TX.distance_inside(make(m).drop("class_id"), N, N).collect():
        want = np.sqrt(((bg - [r["row"], r["col"]]) ** 2).sum(axis=1).min())
        assert abs(r["distance"] - want) < 1e-9


def test_water_gate_removes_ghost_water(spark, make):
    m = np.zeros((32, 32), int)
    m[10:20, 10:20] = 4
    prob = spark.createDataFrame([(1, r, 0, 31, 0.2) for r in range(32)], "raster_id long, row int, c0 int, c1 int, prob double")
    assert PP.refine_water(make(m), (32, 32), prob).filter("class_id = 4").isEmpty()


def test_gap_fill_only_grows_into_background(make, dense):
    m = np.zeros((40, 60), int)
    m[20, :25], m[20, 35:] = 1, 1
    m[20, 28:30] = 3
    out = dense(PP.road_gap_fill(make(m), (60, 40)), m.shape, "class_id")
    assert (out[20, 25:28] == 1).all() and (out[20, 30:35] == 1).all() and (out[20, 28:30] == 3).all()


def test_failing_stage(make):
    def broken(_):
        raise PP.StageError("no")

    def lost(_):
        raise RuntimeError("executor lost")
    m = make(BLOBS)
    assert PP.run_stages(m, [("broken", broken)], strict=False).count() == m.count()
    with pytest.raises(PP.StageError):
        PP.run_stages(m, [("broken", broken)])
    with pytest.raises(RuntimeError):      # only what a stage raises itself may be passed over
        PP.run_stages(m, [("lost", lost)], strict=False)


def test_spans_road(make):
    m = np.zeros((40, 40), int)
    m[20, :5], m[20, 35:], m[18:23, 15:25] = 1, 1, 3
    lab = C.label_components(make(m).filter("class_id = 3"), (40, 40))
    assert PP.spans_road(lab, R.class_layer(make(m), 1), (40, 40), reach=20).count() == 1
    m[20, 35:] = 0
    m[20, :5] = 0
    m[20, 2:4] = 1
    assert PP.spans_road(lab, R.class_layer(make(m), 1), (40, 40), reach=20).count() == 0


def test_window_clip(make):
    m = R.window_clip(make(BLOBS), 5, 6, 20, 21)
    assert m.agg(F.sum(R.run_len())).first()[0] == (BLOBS[5:25, 6:27] > 0).sum()


def test_lower_envelope_is_exact_and_linear():
    import time
    rng = np.random.default_rng(9)
    for n in (1, 2, 7, 60):
        for left in (False, True):
            for right in (False, True):
                f = np.where(rng.random(n) < 0.2, np.inf, rng.integers(1, 40, n).astype(float) ** 2)
                x = np.arange(n)
                sites = [*zip(x, f), *([(-1, 0.0)] if left else []), *([(n, 0.0)] if right else [])]
                want = np.min([(x - p) ** 2 + h for p, h in sites], axis=0)
                assert (TX.lower_envelope(f, left, right) == want).all()
    long = np.full(100_000, 1e10)
    t = time.time()
    assert TX.lower_envelope(long, True, True).max() == 50_000.0**2 and time.time() - t < 3


def test_width_is_twice_the_median(make):
    m = np.zeros((N, N), int)
    m[5:12, 3:40], m[30:34, 2:9] = 1, 1
    runs = make(m).drop("class_id")
    d = [r["distance"] for r in TX.distance_inside(runs, N, N).collect()]
    assert abs(TX.width_estimate(runs, N, N).first()["width_px"] - 2 * np.median(d)) < 1e-12
    odd = runs.where("row < 12 and row > 4").limit(1)
    one = [r["distance"] for r in TX.distance_inside(odd, N, N).collect()]
    assert abs(TX.width_estimate(odd, N, N).first()["width_px"] - 2 * np.median(one)) < 1e-12
