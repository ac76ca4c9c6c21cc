"""Polygons, geometry expressions, repair and rings."""

import numpy as np
from pyspark.sql import functions as F

from gridrun.functions import geometry as G
from gridrun.operators import polygons as PO
from gridrun.operators import vector as VE
from gridrun.operators.burn import burn_runs, scan_rings
from gridrun.operators.components import label_components

RINGS = "array<array<struct<x:double,y:double>>>"


def pts(*p):
    return [{"x": float(x), "y": float(y)} for x, y in p]


def shape():
    m = np.zeros((30, 30), int)
    m[2:20, 3:22] = 1
    m[6:10, 8:12] = 0          # hole
    m[14:16, 20:28] = 1        # arm
    m[22:28, 5:9] = 1          # second component
    m[20, 22] = 1              # touches only by its corner
    return m


def test_ring_area_and_doubling(spark, make):
    lab = label_components(make(shape()), (30, 30), connectivity=4)
    a = PO.rings(lab)
    b = PO.rings(lab, max_local=3)       # every outline through pointer doubling
    def loops(df):
        out = {}
        for r in df.collect():
            out.setdefault((r["comp_id"], r["ring_id"]), []).append((r["pos"], r["x"], r["y"]))
        norm = set()
        for (comp, _), v in out.items():
            v = [(x, y) for _, x, y in sorted(v)]
            k = v.index(min(v))
            norm.add((comp, tuple(v[k:] + v[:k])))
        return norm
    assert loops(a) == loops(b)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    area = {}
    for comp, v in loops(a):
        s = sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(v, v[1:] + v[:1])) / 2
        area[comp] = area.get(comp, 0) + s
    m = {r["comp_id"]: r["area_px"] for r in PO.boundary_measures(lab, 1.0).collect()}
    assert {k: abs(v) for k, v in area.items()} == m


def test_perimeter(make):
    m = np.zeros((10, 10), int)
    m[2:5, 2:7] = 1
    r = PO.boundary_measures(label_components(make(m), (10, 10), connectivity=4), 2.0).first()
    assert r["area_px"] == 15 and r["area_m2"] == 60.0 and r["perimeter_m"] == 32.0


def test_clip_and_area(spark):
    df = spark.createDataFrame([(1, [pts((-5, 5), (5, 5), (5, -5), (-5, -5), (-5, 5))])], f"raster_id long, rings {RINGS}")
    ring = G.clip_half_plane(F.col("rings")[0], "x", F.lit(0.0), True)
    ring = G.clip_half_plane(ring, "y", F.lit(2.0), False)
    assert df.select(G.area(ring)).first()[0] == 5 * 7
    c = df.select(G.centroid(F.col("rings")[0]).alias("c")).first()["c"]
    assert abs(c["x"]) < 1e-12 and abs(c["y"]) < 1e-12


def test_holes_and_further_parts(spark):
    outer, hole, part = [(0, 0), (8, 0), (8, 8), (0, 8), (0, 0)], [(2, 2), (2, 4), (4, 4), (4, 2), (2, 2)], [(10, 0), (12, 0), (12, 2), (10, 2), (10, 0)]
    bow = [(3, 3), (9, 5), (9, 3), (3, 5), (3, 3)]
    shapes = {1: [outer], 2: [outer, hole], 3: [outer, bow], 4: [outer, part], 5: [outer, hole]}
    df = spark.createDataFrame([(1, k, 1, "a", [pts(*r) for r in rs]) for k, rs in shapes.items()], f"raster_id long, feature_id long, class_id int, source string, rings {RINGS}")
    cat = spark.createDataFrame([(1, 1.0, 0.0, -1.0, 11.0, 11, 11)], "raster_id long, gt_a double, gt_c double, gt_e double, gt_f double, width int, height int")
    area = {r["feature_id"]: r["area_m2"] for r in VE.clip_to_frame(df, cat).collect()}
    assert (area[1], area[2], area[4], area[5]) == (64.0, 60.0, 66.0, 60.0)      # half of the part lies outside
    assert {r["feature_id"]: r["defect"] for r in VE.validity(df).collect()} == {1: None, 2: None, 3: "self_crossing", 4: None, 5: None}
    expected = spark.createDataFrame([("a", 1)], "source string, class_id int")
    assert VE.layer_defects(df, expected).first()["duplicate"] == 1      # 2 and 5, not 1 and 2
    c = df.filter("feature_id = 2").select(G.rings_centroid(F.col("rings")).alias("c")).first()["c"]
    assert abs(c["x"] - (64 * 4 - 4 * 3) / 60) < 1e-9 and abs(c["y"] - c["x"]) < 1e-9
    fixed = VE.clip_to_frame(VE.repair(df), cat)
    assert {r["feature_id"]: r["area_m2"] for r in fixed.filter("feature_id in (1, 4)").collect()} == {1: 64.0, 4: 66.0}
    assert fixed.filter("area_m2 = 60.0").count() == 1


def test_validity_and_repair(spark):
    rows = [(1, 1, 1, "a", [pts((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))]),
            (1, 2, 1, "a", [pts((0, 0), (4, 4), (4, 0), (0, 4), (0, 0))]),
            (1, 3, 1, "a", [pts((0, 0), (4, 0), (4, 4), (0, 4))]),
            (1, 4, 1, "a", []), (1, 5, 1, "a", [pts((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))])]
    df = spark.createDataFrame(rows, f"raster_id long, feature_id long, class_id int, source string, rings {RINGS}")
    d = {r["feature_id"]: r["defect"] for r in VE.validity(df).collect()}
    assert d == {1: None, 2: "self_crossing", 3: "unclosed", 4: "empty", 5: None}
    fixed = VE.repair(df)
    assert VE.validity(fixed).filter("defect is not null").isEmpty()
    sizes = sorted(len(r["rings"]) for r in fixed.collect())
    assert sizes == [1, 2]                # copies merged, the crossing one split in two


def test_layer_defects_missing_layer(spark):
    df = spark.createDataFrame([(1, 1, 1, "a", [pts((0, 0), (4, 0), (4, 4), (0, 0))])], f"raster_id long, feature_id long, class_id int, source string, rings {RINGS}")
    exp = spark.createDataFrame([("a", 1), ("a", 2)], "source string, class_id int")
    got = {r["class_id"]: (r["invalid"], r["empty"], r["duplicate"]) for r in VE.layer_defects(df, exp).collect()}
    assert got == {1: (0, 0, 0), 2: (-1, -1, -1)}


def test_utm_round_trip_and_origin(spark):
    df = spark.createDataFrame([(75.0, 0.0), (76.3, 31.2), (73.9, 18.5)], "lon double, lat double")
    x, y = G.lonlat_to_utm(F.col("lon"), F.col("lat"), 32643)
    d = df.select("lon", "lat", x.alias("x"), y.alias("y"))
    lo, la = G.utm_to_lonlat(F.col("x"), F.col("y"), 32643)
    rows = d.select("*", lo.alias("lo"), la.alias("la")).collect()
    assert abs(rows[0]["x"] - 500000) < 1e-6 and abs(rows[0]["y"]) < 1e-6
    for r in rows:
        assert abs(r["lo"] - r["lon"]) < 1e-8 and abs(r["la"] - r["lat"]) < 1e-8      # about a millimetre


def test_triangle_fill_by_pixel_centre(spark, dense):
    f = spark.createDataFrame([(1, 1, 2, [pts((0, 0), (10, 0), (0, -10), (0, 0))])], f"raster_id long, feature_id long, class_id int, rings {RINGS}")
    cat = spark.createDataFrame([(1, 1.0, 0.0, -1.0, 0.0, 12, 12)], "raster_id long, gt_a double, gt_c double, gt_e double, gt_f double, width int, height int")
    got = dense(burn_runs(scan_rings(f, cat)), (12, 12))
    want = np.array([[(c + .5) + (r + .5) < 10 for c in range(12)] for r in range(12)]).astype(int)
    assert (got == want).all()


def test_min_area_box(make):
    m = np.zeros((20, 20), int)
    m[4:9, 3:15] = 1
    r = PO.min_area_box(label_components(make(m), (20, 20))).first()
    assert abs(r["width"] - 5) < 1e-9 and abs(r["height"] - 12) < 1e-9


def test_box_within_reach_over_cell_borders(spark):
    """Gaps of exactly the reach and one more, at every place against the cell grid."""
    from gridrun.operators.vector import has_box_within
    boxes = lambda rows: spark.createDataFrame(rows, "raster_id long, feature_id long, c0 int, r0 int, w int, h int")
    near = [(1, k, 200 + k, 200, 6, 5) for k in range(64)]
    for gap, want in ((16, 64), (17, 0)):
        right = boxes([(1, 1000 + k, 200 + k + 6 + gap, 200, 3, 5) for k in range(64)])
        one = [has_box_within(boxes([near[k]]), right.filter(f"feature_id = {1000 + k}"), 16).count() for k in (35, 36, 37, 41, 42, 43)]
        assert sum(one) == (6 if want else 0)
        left = boxes([(1, 1, 200 - gap - 3, 200, 3, 5)])
        assert has_box_within(boxes([(1, 5, 200, 200, 6, 5)]), left, 16).count() == (1 if want else 0)


def test_utm_far_off_the_zone(spark):
    """A quarter turn away and at the pole a sine rounds to one; the round trip of a point far off has a value."""
    df = spark.createDataFrame([(165.0, 1e-9), (164.999999999, 0.0), (75.0, 90.0), (-15.0, -1e-9)], "lon double, lat double")
    x, y = G.lonlat_to_utm(F.col("lon"), F.col("lat"), 32643)
    assert all(r["x"] is not None and r["y"] is not None for r in df.select(x.alias("x"), y.alias("y")).collect())
    far = spark.createDataFrame([(60503500.0, 3195500.0), (120501500.0, 3195500.0)], "x double, y double")
    lo, la = G.utm_to_lonlat(F.col("x"), F.col("y"), 32643)
    bx, by = G.lonlat_to_utm(F.col("lo"), F.col("la"), 32643)
    assert far.select(lo.alias("lo"), la.alias("la")).select(bx.alias("bx"), by.alias("by")).dropna().count() == 2
