"""Ranking helpers, metrics, calibration, histories, catalogs and sources."""

import json
import random

import pytest
from pyspark.sql import functions as F

from gridrun.operators import calibrate as CA
from gridrun.operators import catalog as CT
from gridrun.operators import history as H
from gridrun.operators import metrics as M
from gridrun.operators import ranking as RK
from gridrun.sources import inventory as IN


def test_number_rows_with_hot_key(spark):
    """One key holds almost all rows; numbering must still be exact."""
    rows = [(0, i) for i in random.Random(1).sample(range(5000), 3000)] + [(k, k) for k in range(1, 20)]
    df = spark.createDataFrame(rows, "k long, v long")
    got = {(r["k"], r["v"]): r["rn"] for r in RK.number_rows(df, ["k"], ["-v"], chunks=7).collect()}
    hot = sorted((v for k, v in rows if k == 0), reverse=True)
    assert all(got[(0, v)] == i + 1 for i, v in enumerate(hot)) and len(got) == len(rows)
    every = RK.number_rows(df, [], ["k", "v"], chunks=5).orderBy("rn").collect()
    assert [r["rn"] for r in every] == list(range(1, len(rows) + 1)) and [(r["k"], r["v"]) for r in every] == sorted(rows)


def test_running_and_top_k(spark):
    rows = [(i % 2, i, float((i * 37) % 101)) for i in range(400)]
    df = spark.createDataFrame(rows, "run long, epoch long, metric double")
    got = {(r["run"], r["epoch"]): r["b"] for r in RK.running(df, ["run"], ["epoch"], {"b": ("max", "metric")}, chunks=6).collect()}
    for run in (0, 1):
        best = None
        for _, e, m in [r for r in rows if r[0] == run]:
            assert got[(run, e)] == best
            best = m if best is None else max(best, m)
    top = RK.top_k(df, ["run"], ["-metric", "epoch"], 5).collect()
    for run in (0, 1):
        want = sorted([r for r in rows if r[0] == run], key=lambda r: (-r[2], r[1]))[:5]
        assert sorted((r["rank"], r["epoch"]) for r in top if r["run"] == run) == [(i + 1, w[1]) for i, w in enumerate(want)]


def test_spacing_rounds_equal_walk(spark):
    rnd = random.Random(3)
    rows = [(k, rnd.random() * 100, 0, i, rnd.random() * 60, rnd.random() * 60) for k in (1, 2) for i in range(80)]
    df = spark.createDataFrame(rows, "raster_id long, score double, kind int, idx long, cx double, cy double")
    order = ["-score", "kind", "idx"]
    pick = lambda d: sorted((r["raster_id"], r["rank"], r["idx"]) for r in d.collect())
    assert pick(RK.keep_spaced(df, 6, 10, order)) == pick(RK.keep_spaced(df, 6, 10, order, small=10))


def test_counts_metrics_by_hand(spark):
    c = spark.createDataFrame([(1, "Road", 80, 100, 90), (2, "Bridge", 0, 0, 0), (3, "Built", 50, 100, 60), (4, "Water", 90, 100, 95)],
                              "class_id int, name string, tp long, gt_pixels long, pred_pixels long")
    m = {r["name"]: r for r in M.pr_metrics(c).collect()}
    assert abs(m["Road"]["recall"] - 0.8) < 1e-9 and abs(m["Road"]["iou"] - 80 / 110) < 1e-9
    mean = M.pr_metrics(c).agg(M.fg_mean().alias("m")).first()["m"]
    assert abs(mean - (80 / 110 + 50 / 110 + 90 / 105) / 3) < 1e-9          # absent class left out


def test_coordinate_descent_against_plain_search(spark):
    rnd = random.Random(9)
    rows = [(rnd.randrange(5), [rnd.gauss(0, 1) for _ in range(5)]) for _ in range(400)]
    df = spark.createDataFrame(rows, "gt int, z array<double>")

    def miou(bias):
        p = [max(range(5), key=lambda k: (z[k] + bias[k], -k)) for _, z in rows]
        out = []
        for c in range(1, 5):
            g = sum(t == c for t, _ in rows)
            i = sum(t == c and q == c for (t, _), q in zip(rows, p))
            u = sum(t == c or q == c for (t, _), q in zip(rows, p))
            if g:
                out.append(i / (u + 1e-10))
        return sum(out) / len(out)

    bias, best = [0.0] * 5, miou([0.0] * 5)
    for _ in range(3):
        changed = False
        for c in range(5):
            for v in CA.GRIDS[c]:
                t = bias[:c] + [v] + bias[c + 1:]
                s = miou(t)
                if s > best + 1e-5:
                    bias, best, changed = t, s, True
        if not changed:
            break
    got, score = CA.coordinate_descent(df)
    assert got == bias and abs(score - best) < 1e-12


def test_zero_streaks_and_ema(spark):
    vals = [0.0, 0.0, 0.3, 0.0, 0.0, 0.0, 0.5, 0.1]
    h = spark.createDataFrame([(1, i + 1, v) for i, v in enumerate(vals)], "run long, epoch long, metric double")
    s = [r["streak"] for r in H.zero_streaks(h).orderBy("epoch").collect()]
    assert s == [1, 2, 0, 1, 2, 3, 0, 0]
    assert H.early_stop(h, 3).first()["stop_epoch"] == 6
    e = vals[0]
    for v in vals[1:]:
        e = 0.99 * e + 0.01 * v
    assert abs(H.ema(h).first()["ema"] - e) < 1e-12


@pytest.mark.parametrize("size,patch,stride", [(1000, 768, 640), (500, 768, 640), (256, 64, 48), (900, 256, 224)])
def test_tile_positions(spark, size, patch, stride):
    want = [0] if size <= patch else list(range(0, size - patch + 1, stride))
    if size > patch and want[-1] + patch < size:
        want.append(size - patch)
    assert spark.range(1).select(CT.tile_positions(size, patch, stride).alias("p")).first()["p"] == want


def test_config(spark, tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"classes": [{"id": 1, "name": "Road", "color_rgb": [1, 2, 3]}], "splits": {"train_tiffs": ["a", "b"], "val_tiffs": ["c"]}}, indent=1))
    c = IN.load_config(spark, str(p))
    assert c["classes"].first().asDict() == {"class_id": 1, "name": "Road", "red": 1, "green": 2, "blue": 3}
    assert sorted(tuple(r) for r in c["splits"].collect()) == [("a", "train"), ("b", "train"), ("c", "val")]


def test_calibration_vector(spark):
    cls = spark.createDataFrame([(k,) for k in range(5)], "class_id int")
    stored = spark.createDataFrame([(1, 0.25)], "class_id int, bias double")
    got = {r["class_id"]: r["bias"] for r in IN.calibration_vector(cls, stored).collect()}
    assert got == {0: 0.0, 1: 0.25, 2: 4.0, 3: 0.0, 4: 0.0}
    with pytest.raises(Exception):
        IN.calibration_vector(cls, stored, strict=True).collect()


def test_manifest_status(spark):
    m = spark.createDataFrame([("a", "AB"), ("b", "cd"), ("c", "ef")], "path string, sha256 string")
    a = spark.createDataFrame([("a", "ab"), ("b", "xx")], "path string, sha256 string")
    got = {r["path"]: r["status"] for r in IN.verify_manifest(m, a).collect()}
    assert got == {"a": "ok", "b": "checksum mismatch", "c": "missing"}
