import numpy as np

from gridrun.operators import polygons as PO
from gridrun.operators.components import label_components


def measures(m, lab):
    """Area and open sides of every component, pixel by pixel."""
    out = {}
    for (r, c), k in np.ndenumerate(lab):
        if k >= 0:
            side = sum(not (0 <= r + dr < m.shape[0] and 0 <= c + dc < m.shape[1] and m[r + dr, c + dc] == m[r, c]) for dr, dc in ((0, 1), (1, 0), (0, -1), (-1, 0)))
            a, e = out.get(int(k), (0, 0))
            out[int(k)] = a + 1, e + side
    return out


def test_boundary_measures_in_strips_equal_pixels(spark, make, monkeypatch):
    rnd = np.random.default_rng(9)
    m = rnd.choice([0, 1, 3], (23, 31), p=[0.3, 0.4, 0.3])
    for connectivity, tile in ((8, 512), (4, 8)):
        runs = label_components(make(m), (31, 23), connectivity=connectivity, tile=tile).localCheckpoint()
        lab = np.full(m.shape, -1)
        for r in runs.collect():
            lab[r.row, r.c0 : r.c1 + 1] = r.comp_id
        for strip in (1, 4, 512):
            monkeypatch.setattr(PO, "STRIP", strip)
            d = PO.boundary_measures(runs, 2.0)
            got = {r.comp_id: (r.area_px, r.perimeter_m / 2) for r in d.collect()}
            assert got == measures(m, lab)
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan        # rows are neither cut into events nor sorted


def test_rings_in_one_call_equal_rings_one_by_one(spark, make):
    """Batches end inside components."""
    rnd = np.random.default_rng(4)
    runs = label_components(make((rnd.random((40, 40)) < 0.6).astype(int)), (40, 40), connectivity=4).localCheckpoint()
    whole = sorted(map(tuple, PO.rings(runs).collect()))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        assert sorted(map(tuple, PO.rings(runs).collect())) == whole
        assert "FlatMapGroupsInPandas" not in PO.rings(runs)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
