"""Vector layer operators: candidate joins, clipping, validity, repair."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridrun.functions import geometry as G

RINGS = "array<array<struct<x:double,y:double>>>"


def frame_box(df: DataFrame) -> DataFrame:
    """World bounds of north-up rasters as fx0, fy0, fx1, fy1."""
    return (df.withColumn("fx0", F.col("gt_c")).withColumn("fx1", F.col("gt_c") + F.col("gt_a") * F.col("width"))
            .withColumn("fy1", F.col("gt_f")).withColumn("fy0", F.col("gt_f") + F.col("gt_e") * F.col("height")))


def overlapping_layers(layers: DataFrame, rasters: DataFrame) -> DataFrame:
    """Layers whose bounds strictly overlap a raster of the same source.

    ``layers`` has one row per (source, class): its bounds are aggregated
    before the join.
    """
    return rasters.join(layers, "source").filter("x0 < fx1 and x1 > fx0 and y0 < fy1 and y1 > fy0")


def clip_to_frame(features: DataFrame, catalog: DataFrame) -> DataFrame:
    """All rings clipped to the raster frame, with the area of what is left (holes taken off); features without area are dropped."""
    dims = frame_box(catalog).select("raster_id", "fx0", "fx1", "fy0", "fy1", "gt_a", "gt_e", "width", "height")
    d = features.filter(F.size("rings") > 0).join(dims, "raster_id")
    b = F.col("_b")
    d = d.withColumn("_b", G.rings_bbox(F.col("rings")))
    d = d.filter((b["x1"] > F.col("fx0")) & (b["x0"] < F.col("fx1")) & (b["y1"] > F.col("fy0")) & (b["y0"] < F.col("fy1")))
    # Only features that reach over an edge are cut at that edge.
    for axis, limit, above in (("x", "fx0", True), ("x", "fx1", False), ("y", "fy0", True), ("y", "fy1", False)):
        inside = b[f"{axis}0"] >= F.col(limit) if above else b[f"{axis}1"] <= F.col(limit)
        cut = F.transform("rings", lambda r: G.let(r, lambda q: G.clip_half_plane(q, axis, F.col(limit), above)))
        d = d.withColumn("rings", F.when(inside, F.col("rings")).otherwise(cut))
    d = d.withColumn("rings", F.filter("rings", lambda r: F.size(r) >= 4))
    d = d.withColumn("area_m2", G.rings_area(F.col("rings")))
    return d.filter("area_m2 > 0").drop("fx0", "fy0", "fx1", "fy1", "_b")


def window_candidates(boxes: DataFrame, windows: DataFrame, cell: int = 64, keep_windows: tuple[str, ...] = ("window_id",)) -> DataFrame:
    """Boxes meeting windows, by an equi-join on grid cells.

    ``boxes``: raster_id, feature_id, c0, r0, w, h; ``windows``: raster_id,
    window_id, wr, wc, wh, ww. A pair is kept only in the cell that holds the
    top-left corner of the overlap, so no de-duplication shuffle is needed.
    """
    span = lambda lo, n: F.sequence(F.floor(lo / cell), F.floor((lo + n - 1) / cell))
    b = boxes.select("*", F.explode(span(F.col("r0"), F.col("h"))).alias("gr")).select(
        "*", F.explode(span(F.col("c0"), F.col("w"))).alias("gc"))
    w = windows.select("*", F.explode(span(F.col("wr"), F.col("wh"))).alias("gr")).select(
        "*", F.explode(span(F.col("wc"), F.col("ww"))).alias("gc"))
    return b.join(w, ["raster_id", "gr", "gc"]).filter(
        "c0 < wc + ww and c0 + w > wc and r0 < wr + wh and r0 + h > wr "
        f"and gr = floor(greatest(r0, wr) / {cell}) and gc = floor(greatest(c0, wc) / {cell})").drop("gr", "gc")


def has_box_within(targets: DataFrame, others: DataFrame, reach: int, cell: int = 64) -> DataFrame:
    """Target boxes with any other box within ``reach`` pixels (Euclidean gap).

    A semi join: it stops at the first hit and emits no pairs. Equal boxes on
    the other side are merged first.
    """
    span = lambda lo, n: F.sequence(F.floor(lo / cell), F.floor((lo + n - 1) / cell))
    # a gap of exactly ``reach`` leaves the other box's nearest pixel one further off
    t = targets.select("*", F.explode(span(F.col("r0") - reach - 1, F.col("h") + 2 * reach + 2)).alias("gr")).select(
        "*", F.explode(span(F.col("c0") - reach - 1, F.col("w") + 2 * reach + 2)).alias("gc"))
    o = others.select("raster_id", F.col("c0").alias("oc"), F.col("r0").alias("orr"), F.col("w").alias("ow"), F.col("h").alias("oh")).distinct()
    o = o.select("*", F.explode(span(F.col("orr"), F.col("oh"))).alias("gr")).select("*", F.explode(span(F.col("oc"), F.col("ow"))).alias("gc"))
    gx = F.greatest(F.col("oc") - (t["c0"] + t["w"]), t["c0"] - (F.col("oc") + F.col("ow")), F.lit(0))
    gy = F.greatest(F.col("orr") - (t["r0"] + t["h"]), t["r0"] - (F.col("orr") + F.col("oh")), F.lit(0))
    near = gx * gx + gy * gy <= reach * reach
    on = (t["raster_id"] == o["raster_id"]) & (t["gr"] == o["gr"]) & (t["gc"] == o["gc"]) & near
    return t.join(o, on, "left_semi").drop("gr", "gc").distinct()


#: Pairs of segments compared at once.
AT_ONCE = 1_000_000
#: Up to so many segments of a feature are compared pair by pair, more meet in grid cells.
FEW = 64


def _points(rings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rings per feature, points per ring, and the coordinates of all points; null is NaN."""
    each = rings.flatten()
    x, y = (c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in each.flatten().flatten())
    return rings.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), each.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), x, y


def _counted(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For group sizes ``n``: the group of every member and its number in the group."""
    g = np.repeat(np.arange(len(n)), n)
    return g, np.arange(len(g)) - np.repeat(np.cumsum(n) - n, n)


def _pairs(size: np.ndarray):
    """Pairs ``p < q`` of members of the same group, groups of ``size`` in a row, in batches."""
    n = int(size.sum())
    later = np.repeat(np.cumsum(size), size) - np.arange(n) - 1
    upto = np.cumsum(later)
    lo = 0
    while lo < n:
        hi = max(int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + AT_ONCE, "right")), lo + 1)
        p, i = _counted(later[lo:hi])
        yield p + lo, p + lo + 1 + i
        lo = hi


def _by_cell(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments of one feature by grid cell, about one mean segment per cell: segments in the order of cells, and the cells' sizes."""
    ok = np.flatnonzero(np.isfinite(x0 + y0 + x1 + y1))
    if not len(ok):
        return ok, ok
    low = lambda a, z: (np.minimum(a, z) - min(a.min(), z.min()), np.maximum(a, z) - min(a.min(), z.min()))
    (xa, xz), (ya, yz) = low(x0[ok], x1[ok]), low(y0[ok], y1[ok])
    side = max(max(xz.max(), yz.max()) / np.ceil(np.sqrt(len(ok))), 1e-9)
    gx, gy, hx, hy = (np.floor(v / side).astype(np.int64) for v in (xa, ya, xz, yz))
    seg, i = _counted((hx - gx + 1) * (hy - gy + 1))
    tall = (hy - gy + 1)[seg]
    cell = (gx[seg] + i // tall) * (int(hy.max()) + 1) + gy[seg] + i % tall
    order = np.argsort(cell, kind="stable")
    return ok[seg[order]], np.unique(cell, return_counts=True)[1]


def _crossing(rings: pa.Array) -> np.ndarray:
    """Per feature whether a ring crosses itself or another ring of the feature."""
    per, size, x, y = _points(rings)
    feature = np.repeat(np.arange(len(per)), per)
    start, n = np.cumsum(size) - size, np.where(size >= 4, size - 1, 0)
    ring, i = _counted(n)
    own, a = feature[ring], start[ring] + i
    x0, y0, x1, y1 = x[a], y[a], x[a + 1], y[a + 1]
    turn = lambda ax, ay, bx, by, cx, cy: np.sign((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))
    out = np.zeros(len(per), bool)

    def test(p, q):
        p, q = np.minimum(p, q), np.maximum(p, q)
        use = (ring[p] != ring[q]) | ((i[q] > i[p] + 1) & ~((i[p] == 0) & (i[q] == n[ring[p]] - 1)))
        p, q = p[use], q[use]
        s, t = (x0[p], y0[p], x1[p], y1[p]), (x0[q], y0[q], x1[q], y1[q])
        hit = (turn(*s, *t[:2]) * turn(*s, *t[2:]) < 0) & (turn(*t, *s[:2]) * turn(*t, *s[2:]) < 0)
        out[own[p[hit]]] = True

    many = np.bincount(own, minlength=len(per))
    first = np.cumsum(many) - many
    few = np.flatnonzero(many[own] <= FEW)
    for p, q in _pairs(np.where(many <= FEW, many, 0)):
        test(few[p], few[q])
    for f in np.flatnonzero(many > FEW):
        mine = slice(first[f], first[f] + many[f])
        seg, cells = _by_cell(x0[mine], y0[mine], x1[mine], y1[mine])
        for p, q in _pairs(cells):
            test(first[f] + seg[p], first[f] + seg[q])
    return out


def crosses() -> Column:
    """Whether a feature crosses itself; a feature without a key is never said to."""
    def test(rings: pa.Array) -> pa.Array:
        return pa.array(_crossing(rings))

    return F.coalesce(F.col("raster_id").isNotNull() & F.col("feature_id").isNotNull() & F.arrow_udf(test, "boolean")("rings"), F.lit(False))


def self_crossing(features: DataFrame) -> DataFrame:
    """Keys of features with a ring that crosses itself or another ring of the feature.

    A feature is tested in its row. Its segments meet through grid cells of about one mean segment per cell, so a
    feature with many vertices is not compared pair by pair.
    """
    return features.filter(crosses()).select("raster_id", "feature_id").distinct()


def validity(features: DataFrame) -> DataFrame:
    """Features with ``defect``: empty, too_few, unclosed, self_crossing or null."""
    simple = F.when(F.size(F.flatten("rings")) == 0, "empty").when(F.exists("rings", lambda r: F.size(r) < 4), "too_few").when(
        F.exists("rings", lambda r: (r[0]["x"] != F.element_at(r, -1)["x"]) | (r[0]["y"] != F.element_at(r, -1)["y"])), "unclosed")
    return features.withColumn("_x", crosses()).withColumn("defect", F.coalesce(simple, F.when(F.col("_x"), "self_crossing"))).drop("_x")


def layer_defects(features: DataFrame, expected: DataFrame, count: bool = False) -> DataFrame:
    """Invalid, empty and duplicate counts per (source, class); -1 thrice for a missing layer. ``count`` adds all ``features``, 0 for a missing one."""
    v = validity(features)
    ring = F.when(F.size("rings") > 0, G.rings_wkt(F.col("rings"))).otherwise("EMPTY")
    # Copies are counted per distinct geometry hash first, so a huge group of equal shapes shrinks early.
    per = v.select("source", "class_id", "defect", F.unhex(F.sha2(ring, 256)).alias("h")).groupBy("source", "class_id", "h").agg(
        F.count("*").alias("n"), F.count_if((F.col("defect") != "empty") & F.col("defect").isNotNull()).alias("bad"),
        F.count_if(F.col("defect") == "empty").alias("empty"))
    got = per.groupBy("source", "class_id").agg(
        F.sum("bad").alias("invalid"), F.sum("empty").alias("empty"), (F.sum("n") - F.count("*")).alias("duplicate"), F.sum("n").alias("features"))
    out = expected.join(got, ["source", "class_id"], "left").fillna(-1, ["invalid", "empty", "duplicate"]).fillna(0, ["features"])
    return out if count else out.drop("features")


def _turn(ring) -> float:
    """Twice the signed area of a ring, closed or not."""
    pts = [(p["x"], p["y"]) for p in ring]
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(pts, pts[1:] + pts[:1], strict=True))


def _repair_rings(rings):
    """Repaired rings of one feature: parts turn counter-clockwise, holes (rings turning against the first one) clockwise."""
    first = _turn(rings[0]) if len(rings) else 0.0
    return [part for k, r in enumerate(rings) for part in _repair_ring(r, hole=k > 0 and _turn(r) * first < 0)]


def _repair_ring(ring, hole=False):
    """Closed, de-duplicated simple parts of one ring, turning clockwise for a hole.

    A crossing splits the ring in two at the crossing point; parts with area survive.
    """
    pts = [(p["x"], p["y"]) for p in ring]
    out = [p for i, p in enumerate(pts) if i == 0 or p != pts[i - 1]]
    if len(out) > 1 and out[0] == out[-1]:
        out.pop()
    todo, done = [out], []
    while todo:
        r = todo.pop()
        n = len(r)
        if n < 3:
            continue
        hit = None
        for i in range(n):
            (ax, ay), (bx, by) = r[i], r[(i + 1) % n]
            for j in range(i + 2, n):
                if i == 0 and j == n - 1:
                    continue
                (cx, cy), (dx, dy) = r[j], r[(j + 1) % n]
                den = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
                if den == 0:
                    continue
                t = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / den
                u = ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / den
                if 0 < t < 1 and 0 < u < 1:
                    hit = (i, j, (ax + t * (bx - ax), ay + t * (by - ay)))
                    break
            if hit:
                break
        if hit:
            i, j, x = hit
            todo += [r[:i + 1] + [x] + r[j + 1:], [x] + r[i + 1:j + 1]]
            continue
        a = sum(r[k][0] * r[(k + 1) % n][1] - r[(k + 1) % n][0] * r[k][1] for k in range(n))
        if a:
            r = r if (a > 0) != hole else r[::-1]
            done.append([{"x": p[0], "y": p[1]} for p in r + r[:1]])
    return done


def _repaired(rings: pa.Array) -> pa.Array:
    """``_repair_rings`` of every feature. Features that need no more than closing and turning are done all at once."""
    per, size, x, y = _points(rings)
    feature, start = np.repeat(np.arange(len(per)), per), np.cumsum(size) - size
    point, i = _counted(size)
    bad = np.zeros(len(size), bool)
    bad[point[~np.isfinite(x + y)]] = True
    same = np.flatnonzero((point[1:] == point[:-1]) & (x[1:] == x[:-1]) & (y[1:] == y[:-1]))
    bad[point[same]] = True
    full = np.flatnonzero(size > 0)
    closed = np.zeros(len(size), bool)
    closed[full] = (x[start[full]] == x[start[full] + size[full] - 1]) & (y[start[full]] == y[start[full] + size[full] - 1]) & (size[full] > 1)
    n = size - closed
    bad |= (n < 3) | (n > FEW)
    n = np.where(bad, 0, n)
    ring, i = _counted(n)
    a, z = start[ring] + i, start[ring] + (i + 1) % np.maximum(n[ring], 1)
    x0, y0, x1, y1 = x[a], y[a], x[z], y[z]
    term = x0 * y1 - x1 * y0
    area, noise = (np.bincount(ring, v, minlength=len(size)) for v in (term, np.abs(term)))
    bad |= np.abs(area) <= 1e-15 * n * noise          # too near to 0 to tell the turn from a plain sum
    with np.errstate(divide="ignore", invalid="ignore"):
        for p, q in _pairs(n):
            use = (i[q] > i[p] + 1) & ~((i[p] == 0) & (i[q] == n[ring[p]] - 1))
            p, q = p[use], q[use]
            dx, dy, ex, ey, fx, fy = x1[p] - x0[p], y1[p] - y0[p], x1[q] - x0[q], y1[q] - y0[q], x0[q] - x0[p], y0[q] - y0[p]
            den = dx * ey - dy * ex
            t, u = (fx * ey - fy * ex) / den, (fx * dy - fy * dx) / den
            bad[ring[p[(den != 0) & (0 < t) & (t < 1) & (0 < u) & (u < 1)]]] = True
    slow = np.zeros(len(per), bool)
    slow[feature[bad]] = True
    slow |= rings.is_null().to_numpy(zero_copy_only=False)
    first = area[(np.cumsum(per) - per)[feature]] if len(feature) else area
    back = (area > 0) == ((np.arange(len(size)) > (np.cumsum(per) - per)[feature]) & (np.sign(area) * np.sign(first) < 0))
    keep = ~slow[feature]
    m, s, back = n[keep], start[keep], back[keep]
    r, j = _counted(m + 1)
    take = s[r] + np.where(back[r], m[r] - 1 - j % m[r], j % m[r])
    points = pa.StructArray.from_arrays([pa.array(x[take]), pa.array(y[take])], ["x", "y"])
    offsets = lambda c: pa.array(np.append(0, np.cumsum(c)).astype(np.int32))
    done = pa.ListArray.from_arrays(offsets(per[~slow]), pa.ListArray.from_arrays(offsets(m + 1), points))
    rest = pa.array([_repair_rings(v) for v in rings.filter(pa.array(slow)).to_pylist()], done.type)
    at = np.empty(len(per), np.int64)
    at[~slow], at[slow] = np.arange(len(done)), len(done) + np.arange(len(rest))
    return pa.concat_arrays([done, rest]).take(pa.array(at))


def repair(features: DataFrame) -> DataFrame:
    """Make rings valid, keep polygonal parts, drop empty ones and exact copies."""
    def fix(rings: pa.Array) -> pa.Array:
        return _repaired(rings)

    fixed = features.withColumn("rings", F.arrow_udf(fix, RINGS)("rings")).filter(F.size("rings") > 0)
    return fixed.withColumn("_h", F.unhex(F.sha2(F.to_json("rings"), 256))).dropDuplicates(["source", "class_id", "_h"]).drop("_h")
