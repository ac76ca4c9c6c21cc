import random

import pyarrow as pa

from gridrun.operators import vector as VE

TYPE = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
SCHEMA = "raster_id long, feature_id long, source string, class_id int, rings array<array<struct<x:double,y:double>>>"


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def some_rings(rnd):
    """Boxes, bows, open, doubled, flat and tiny rings, holes either way, stars of more than ``FEW`` corners."""
    out = []
    for _ in range(rnd.randint(0, 3)):
        n = rnd.choice((1, 2, 3, 4, 4, 5, 6, VE.FEW + 6))
        pts = [(rnd.randint(0, 8), rnd.randint(0, 8)) for _ in range(n)]
        if rnd.random() < 0.3:
            pts.insert(rnd.randrange(n), pts[0])
        if rnd.random() < 0.7:
            pts.append(pts[0])
        out.append(ring(*pts))
    return out


def crossing(rings):
    """All pairs of segments, one by one."""
    seg = [(k, i, len(r) - 1, (r[i]["x"], r[i]["y"]), (r[i + 1]["x"], r[i + 1]["y"])) for k, r in enumerate(r for r in rings if len(r) >= 4) for i in range(len(r) - 1)]
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    return any(turn(a, b, c) * turn(a, b, d) < 0 and turn(c, d, a) * turn(c, d, b) < 0
               for k, i, n, a, b in seg for m, j, _, c, d in seg if m > k or (m == k and j > i + 1 and not (i == 0 and j == n - 1)))


def test_crossing_and_repair_at_once_equal_one_by_one():
    rnd = random.Random(7)
    rows = [some_rings(rnd) for _ in range(400)] + [[], [ring((0, 0), (4, 0), (4, 4), (0, 4), (0, 0)), ring((1, 1), (1, 2), (2, 2), (2, 1), (1, 1))]]
    array = pa.array(rows, TYPE)
    want = [crossing(r) for r in rows]
    assert VE._crossing(array).tolist() == want and any(want) and not all(want)
    assert VE._repaired(array).to_pylist() == [VE._repair_rings(r) for r in rows]
    assert VE._repaired(array.slice(5, 60)).to_pylist() == [VE._repair_rings(r) for r in rows[5:65]]
    assert VE._repaired(array.slice(0, 0)).to_pylist() == []


def test_pairs_come_in_batches(monkeypatch):
    monkeypatch.setattr(VE, "AT_ONCE", 3)
    import numpy as np
    got = [(int(a), int(b)) for p, q in VE._pairs(np.array([3, 0, 1, 4])) for a, b in zip(p, q)]
    assert sorted(got) == [(0, 1), (0, 2), (1, 2), (4, 5), (4, 6), (4, 7), (5, 6), (5, 7), (6, 7)]


def test_validity_moves_no_feature_and_repair_is_planned_once(spark):
    box, bow = ring((0, 0), (4, 0), (4, 4), (0, 4), (0, 0)), ring((0, 0), (4, 4), (4, 0), (0, 4), (0, 0))
    df = spark.createDataFrame([(1, 1, "a", 1, [box]), (1, 2, "a", 1, [bow]), (1, 2, "a", 1, [box]), (None, 3, "a", 1, [bow])], SCHEMA)
    v = VE.validity(df)
    assert sorted(r["defect"] or "" for r in v.collect()) == ["", "", "", "self_crossing"]
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(v)
    from gridrun.plans.vector_reports import repair_summary
    expected = spark.createDataFrame([("a", 1), ("b", 1)], "source string, class_id int")
    d = repair_summary(df, expected)
    assert plan(d).count("fix(") <= 2
    got = {r["source"]: r.asDict() for r in d.collect()}
    assert got["a"]["features_before"] == 4 and got["a"]["invalid_before"] == 1 and got["b"]["features_after"] == 0 and got["b"]["invalid_after"] == -1
