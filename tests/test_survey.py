"""Village, spatial and queue semantics on small masks."""

import numpy as np
from pyspark.sql import functions as F

from gridrun.functions import scoring as SC
from gridrun.operators.components import label_components
from gridrun.operators.ranking import keep_spaced
from gridrun.operators.runs import coverage
from gridrun.plans import spatial as SP
from gridrun.plans import visits as V


def catalog(spark, h, w):
    return spark.createDataFrame([(1, w, h)], "raster_id long, width int, height int")


def conf_runs(spark, arr):
    out = []
    for r, line in enumerate(arr):
        for c, v in enumerate(map(float, line)):
            if out and out[-1][1] == r and out[-1][4] == v and out[-1][3] == c - 1:
                out[-1] = (*out[-1][:3], c, v)
            else:
                out.append((1, r, c, c, v))
    return spark.createDataFrame(out, "raster_id long, row int, c0 int, c1 int, conf double")


def queue(spark, make, mask, conf, gsd=0.5):
    h, w = mask.shape
    c = conf_runs(spark, conf)
    low = coverage(c.filter(F.col("conf") < 0.7)).withColumn("class_id", F.lit(0))
    u = label_components(low, (w, h))
    q = V.visit_queue(V.visit_candidates(make(mask), c, u, gsd, (w, h)), gsd)
    return q, V.top_priorities(q, catalog(spark, h, w))


def test_road_access(spark, make):
    m = np.zeros((200, 200), int)
    m[100, 50:150] = 1
    m[80:120, 120:180] = np.where(m[80:120, 120:180] == 1, 1, 3)
    lab = label_components(make(m), (200, 200))
    s = SP.spatial_measures(make(m), lab, catalog(spark, 200, 200), 0.5, (200, 200))
    r = SP.spatial_report(s, 0.5).first()
    assert r["builtup_road_access_pct"] > 0 and r["road_connected_components"] == 1
    assert 0 <= SP.spatial_report(s, 0.5).select(SC.accessibility_score()).first()[0] <= 100


def test_isolated_cluster_first(spark, make):
    m = np.zeros((200, 200), int)
    m[80:140, 80:140] = 3
    q, lines = queue(spark, make, m, np.full(m.shape, 0.4))
    first = q.orderBy("rank").first()
    assert first["access"] == "isolated" and first["score"] > 50 and first["rank"] == 1
    assert "isolated settlement cluster 1" in lines.filter("rank = 1").first()["line"]


def test_empty_village(spark, make):
    m = np.zeros((64, 64), int)
    q, lines = queue(spark, make, m, np.full(m.shape, 0.95))
    assert q.isEmpty() and lines.first()["line"] == SC.NO_PRIORITY


def test_low_confidence_raises_priority(spark, make):
    m = np.zeros((200, 200), int)
    m[100, :] = 1
    m[85:115, 100:150] = np.where(m[85:115, 100:150] == 1, 1, 3)
    score = lambda c: queue(spark, make, m, np.full(m.shape, c))[0].agg(F.max("score")).first()[0]
    assert score(0.35) > score(0.95)


def test_physical_units(spark, make):
    m = np.zeros((100, 100), int)
    m[10:20, 10:90], m[50:70, 50:70], m[80:90, 10:20] = 1, 4, 3
    r = SP.village_report(make(m), label_components(make(m), (100, 100)), catalog(spark, 100, 100), 0.5).first()
    assert r["water_area_m2"] == 100.0 and r["total_area_m2"] == 2500.0 and r["n_buildings"] == 1 and r["rooftop_count"] == 1


def test_wide_radius_path_matches_dilation(spark, make):
    """Above the dilation limit the tiled nearness test must give the same share."""
    m = np.zeros((180, 180), int)
    m[5, :60], m[100:140, 60:120] = 1, 3
    a = SP.builtup_nearness(make(m), 0.5, (180, 180)).first()["near_road_px"]        # radius 100
    d = np.argwhere(m == 1)
    want = sum(1 for y, x in np.argwhere(m == 3) if any(abs(x - c) <= np.floor(np.sqrt(max(0, 100**2 - (y - r)**2)) + .5) and abs(y - r) <= 100 for r, c in d[:]))
    assert a == want


def test_spaced_rounds_keep_what_the_walk_keeps(spark):
    """Crowded cells, ties in place, a slope of scores, and distances of exactly the radius."""
    import random
    rng = random.Random(6)
    rows = [(1, i, rng.random() * 60, rng.random() * 60, float(rng.randrange(50))) for i in range(900)]
    rows += [(2, i, 30.0, 30.0, float(i % 7)) for i in range(300)]
    rows += [(3, i, i * 2.0, 0.0, float(-i)) for i in range(24)]
    rows += [(4, i, (i % 20) * 6.0, (i // 20) * 6.0, float(rng.randrange(9))) for i in range(200)]
    cands = spark.createDataFrame(rows, "raster_id long, idx long, cx double, cy double, score double")
    for items in (3, 10_000):
        walk = sorted(map(tuple, keep_spaced(cands, 6.0, items, ["-score", "idx"], small=10**6).collect()))
        assert sorted(map(tuple, keep_spaced(cands, 6.0, items, ["-score", "idx"], small=5).collect())) == walk and walk


def test_spaced_rounds_on_a_crowded_raster(spark):
    """A million candidates of one raster, a third of them in one cell."""
    n = 1_000_000
    cands = spark.range(n).selectExpr("1L as raster_id", "id as idx", "if(id % 3 = 0, 500.0D, (xxhash64(id, 1) & 1048575) / 1048.576D) as cx",
                                      "if(id % 3 = 0, 500.0D, (xxhash64(id, 2) & 1048575) / 1048.576D) as cy", "(xxhash64(id, 3) & 65535) / 65536D as score")
    got = keep_spaced(cands, 6.0, 50, ["-score", "idx"]).orderBy("rank").collect()
    best = cands.orderBy("score", ascending=False).limit(3000).orderBy(F.desc("score"), "idx").collect()
    kept = []
    for c in best:
        if len(kept) < 50 and all((c.cx - k.cx) ** 2 + (c.cy - k.cy) ** 2 >= 36 for k in kept):
            kept.append(c)
    assert [r.idx for r in got] == [k.idx for k in kept] and len(got) == 50
