"""Mask -> polygon layers: boundary measures, ring tracing, simplification."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridrun.operators.ranking import number_rows
from gridrun.operators.runs import as_layer, overlay
from gridrun.operators.strips import STRIP
from gridrun.session import durable

RING = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
KEY = ["raster_id", "class_id", "comp_id"]


def _exposed(labelled: DataFrame) -> DataFrame:
    """Segments of labelled runs with ``top`` / ``bottom`` true where the row above / below is another class."""
    shift = lambda d: as_layer(labelled.withColumn("row", F.col("row") + d), "class_id")
    o = overlay({"comp_id": as_layer(labelled, "comp_id"), "cls": as_layer(labelled, "class_id"), "up": shift(1), "down": shift(-1)})
    other = lambda c: ~F.col(c).eqNullSafe(F.col("cls"))
    return o.filter("comp_id is not null").select(
        "raster_id", "row", "c0", "c1", F.col("cls").alias("class_id"), "comp_id", other("up").alias("top"), other("down").alias("bottom"))


def boundary_measures(labelled: DataFrame, gsd: float) -> DataFrame:
    """Area and perimeter (holes included) per component, from edge counts alone.

    Classes must not overlap; a component id is then unique within its raster. Pixels of a class above each other are of
    one component. A strip of rows, with the row below it, sums up its components; only the sums leave it.
    """
    id_type = labelled.schema["raster_id"].dataType.simpleString()
    n = max(int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), 2)
    # The first row of a strip also ends the strip above.
    cut = labelled.select("raster_id", "class_id", "comp_id", "row", "c0", "c1", F.explode(F.sequence(F.greatest(F.floor((F.col("row") - 1) / STRIP), F.lit(0)), F.floor(F.col("row") / STRIP))).alias("strip"))

    def summed(key: tuple, t: pa.Table) -> pa.Table:
        cls, comp, row, c0, c1 = (t.column(c).to_numpy().astype(np.int64) for c in ("class_id", "comp_id", "row", "c0", "c1"))
        order = np.lexsort((c0, row, cls))
        cls, comp, row, c0, c1 = (v[order] for v in (cls, comp, row, c0, c1))
        first = key[1].as_py() * STRIP
        own = row >= first
        goes_on = np.append(False, (cls[1:] == cls[:-1]) & (comp[1:] == comp[:-1]) & (row[1:] == row[:-1]) & (c0[1:] == c1[:-1] + 1))
        own &= row < first + STRIP
        # Runs of the class in the next row that share columns, by binary search.
        base, span = int(c0.min()), int(c1.max()) - int(c0.min()) + 2
        line = (cls * (STRIP + 3) + row - first) * span - base
        lo, hi = np.searchsorted(line + c1, line + span + c0, "left"), np.searchsorted(line + c0, line + span + c1, "right")
        many = np.where(own, np.maximum(hi - lo, 0), 0)
        i = np.repeat(np.arange(len(row)), many)
        j = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + lo[i]
        shared = np.bincount(i, np.minimum(c1[i], c1[j]) - np.maximum(c0[i], c0[j]) + 1, minlength=len(row)).astype(np.int64)
        length = c1 - c0 + 1
        edge = 2 * length - 2 * shared + 2 * ~goes_on
        cls, comp, length, edge = cls[own], comp[own], length[own], edge[own]
        order = np.lexsort((comp, cls))
        cls, comp = cls[order], comp[order]
        at = np.flatnonzero(np.append(True, (cls[1:] != cls[:-1]) | (comp[1:] != comp[:-1]))) if len(cls) else np.zeros(0, np.int64)
        total = lambda v: np.add.reduceat(v[order], at) if len(at) else v
        return pa.table({"raster_id": pa.repeat(key[0], len(at)), "class_id": pa.array(cls[at].astype(np.int32)), "comp_id": pa.array(comp[at]), "n": pa.array(total(length)), "e": pa.array(total(edge))})

    sums = cut.repartition(n, "raster_id", "strip").groupBy("raster_id", "strip").applyInArrow(summed, f"raster_id {id_type}, class_id int, comp_id long, n long, e long")
    return sums.groupBy("raster_id", "class_id", "comp_id").agg(F.sum("n").alias("area_px"), F.sum("e").alias("_edge")).select(
        "raster_id", "class_id", "comp_id", "area_px", (F.col("area_px") * (gsd * gsd)).alias("area_m2"), (F.col("_edge") * gsd).alias("perimeter_m"))


def boundary_edges(labelled: DataFrame) -> DataFrame:
    """Directed boundary edges with the component on their right: ``raster_id, comp_id, x0, y0, x1, y1, d``.

    ``d`` is 0 east, 1 south, 2 west, 3 north, in pixel corner coordinates.
    Segments end where exposure changes, so every corner starts an edge.
    """
    c0, z = F.col("c0"), F.col("c1") + 1
    edge = lambda a, b, c, d, k: F.struct(a.alias("x0"), b.alias("y0"), c.alias("x1"), d.alias("y1"), F.lit(k).alias("d"))
    r, r1 = F.col("row"), F.col("row") + 1
    flat = _exposed(labelled).select("raster_id", "comp_id", F.explode(F.array_compact(F.array(
        F.when(F.col("top"), edge(c0, r, z, r, 0)), F.when(F.col("bottom"), edge(z, r1, c0, r1, 2))))).alias("e"))
    sides = labelled.select("raster_id", "comp_id", F.explode(F.array(edge(z, r, z, r1, 1), edge(c0, r1, c0, r, 3))).alias("e"))
    return flat.unionByName(sides).select("raster_id", "comp_id", "e.*")


def _trace(x0, y0, x1, y1, d):
    """Closed corner loops of one component's edges; at a pinch the right turn is taken."""
    start: dict = {}
    for i in range(len(x0)):
        start.setdefault((x0[i], y0[i]), []).append(i)
    used, rings = [False] * len(x0), []
    for s in sorted(range(len(x0)), key=lambda i: (y0[i], x0[i], d[i])):
        if used[s]:
            continue
        ring, i = [], s
        while not used[i]:
            used[i] = True
            ring.append((x0[i], y0[i], d[i]))
            nxt = [j for j in start[(x1[i], y1[i])] if not used[j]]
            if not nxt:
                break
            i = min(nxt, key=lambda j: ((d[j] - d[i] - 1) % 4))
        rings.append([(p[0], p[1]) for k, p in enumerate(ring) if p[2] != ring[k - 1][2]])
    return rings


def rings(labelled: DataFrame, max_local: int = 200_000) -> DataFrame:
    """Ring vertices in order: ``raster_id, comp_id, ring_id, pos, x, y`` (pixel corners, not closed).

    Rings are numbered from 0 by their first edge in (y, x, direction) order,
    corners from 0 on from there. Components with up to ``max_local`` edges are
    traced one after the other. Larger outlines are linked edge to edge and ordered
    by pointer doubling, with the same rows, so no task ever holds one of them.
    """
    edges = durable(boundary_edges(labelled))
    size = edges.groupBy("raster_id", "comp_id").agg(F.count("*").alias("n"))
    big = size.filter(F.col("n") > max_local).drop("n")

    def trace(pdfs):
        rest = None
        for pdf in pdfs:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            raster, comp = pdf["raster_id"].to_numpy(), pdf["comp_id"].to_numpy()
            at = [0, *(np.flatnonzero((raster[1:] != raster[:-1]) | (comp[1:] != comp[:-1])) + 1).tolist()]
            yield traced(pdf, at[:-1], at[1:])
            rest = pdf.iloc[at[-1]:]         # may go on in the next batch
        if rest is not None and len(rest):
            yield traced(rest, [0], [len(rest)])

    def traced(pdf: pd.DataFrame, starts: list[int], ends: list[int]) -> pd.DataFrame:
        raster, comp = pdf["raster_id"].to_numpy(), pdf["comp_id"].to_numpy()
        x0, y0, x1, y1, d = (pdf[c].tolist() for c in ("x0", "y0", "x1", "y1", "d"))
        out = [(raster[a], comp[a], k, i, x, y) for a, z in zip(starts, ends, strict=True)
               for k, ring in enumerate(_trace(x0[a:z], y0[a:z], x1[a:z], y1[a:z], d[a:z])) for i, (x, y) in enumerate(ring)]
        return pd.DataFrame(out, columns=["raster_id", "comp_id", "ring_id", "pos", "x", "y"])

    # Components follow each other in a partition, so many are traced in one call.
    parts = max(int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), 2)
    of = lambda e: e.repartition(parts, "raster_id", "comp_id").sortWithinPartitions("raster_id", "comp_id").mapInPandas(
        trace, "raster_id long, comp_id long, ring_id long, pos long, x int, y int")
    if big.isEmpty():
        return of(edges)
    small = of(edges.join(big, ["raster_id", "comp_id"], "left_anti"))
    return small.unionByName(_rings_by_doubling(edges.join(big, ["raster_id", "comp_id"], "left_semi")))


def _rings_by_doubling(edges: DataFrame) -> DataFrame:
    """The same order for outlines of any size, in O(log n) joins."""
    k = ["raster_id", "comp_id"]
    e = edges.withColumn("id", F.struct("y0", "x0", "d"))
    nxt = e.select(*k, F.col("x0").alias("jx"), F.col("y0").alias("jy"), F.col("d").alias("jd"), F.col("id").alias("to"))
    j = e.withColumn("jx", F.col("x1")).withColumn("jy", F.col("y1")).join(nxt, [*k, "jx", "jy"])
    succ = durable(j.groupBy(*k, "id", "d").agg(F.min_by("to", F.pmod(F.col("jd") - F.col("d") - 1, F.lit(4))).alias("to")).drop("d"))
    # Smallest edge of every ring: minimum over ever longer stretches.
    cur = succ.withColumn("low", F.least("id", "to"))
    while True:
        far = cur.select(*k, F.col("id").alias("to"), F.col("to").alias("to2"), F.col("low").alias("low2"))
        new = durable(cur.join(far, [*k, "to"]).select(*k, "id", F.col("to2").alias("to"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("moved")))
        cur = new.drop("moved")
        if new.filter("moved").isEmpty():
            break
    root = cur.select(*k, "id", F.col("low").alias("root"))
    # Cut each ring before its root and rank by distance to the end.
    step = durable(succ.join(root, [*k, "id"]).withColumn("to", F.when(F.col("to") == F.col("root"), F.lit(None)).otherwise(F.col("to"))).withColumn(
        "dist", F.when(F.col("to").isNull(), 0).otherwise(1).cast("long")))
    while not step.filter("to is not null").isEmpty():
        far = step.select(*k, F.col("id").alias("to"), F.col("to").alias("to2"), F.col("dist").alias("dist2"))
        step = durable(step.join(far, [*k, "to"], "left").select(*k, "id", "root", F.col("to2").alias("to"), (F.col("dist") + F.coalesce("dist2", F.lit(0))).alias("dist")))
    # Corners only: vertices whose incoming edge has another direction.
    prev = succ.select(*k, F.col("to").alias("id"), F.col("id.d").alias("pd"))
    v = step.join(prev, [*k, "id"]).filter("pd <> id.d")
    first = F.col("root.y0").cast("long") * 4 * (1 << 30) + F.col("root.x0").cast("long") * 4 + F.col("root.d")
    placed = durable(v.select(*k, first.alias("first"), "dist", F.col("id.x0").alias("x"), F.col("id.y0").alias("y")))
    ring = number_rows(placed.select(*k, "first").distinct(), k, ["first"], "ring_id")
    at = number_rows(placed, [*k, "first"], ["-dist"], "pos")
    return at.join(ring, [*k, "first"]).select(*k, (F.col("ring_id") - 1).alias("ring_id"), (F.col("pos") - 1).alias("pos"), "x", "y")


def _simplify(points: np.ndarray, tol: float) -> np.ndarray:
    """Douglas-Peucker on an open polyline; indices of the kept points."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    todo = [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        p, q = points[a], points[b]
        v = points[a + 1:b] - p
        w = q - p
        n = math.hypot(*w)
        d = np.abs(v[:, 0] * w[1] - v[:, 1] * w[0]) / n if n else np.hypot(v[:, 0], v[:, 1])
        i = int(d.argmax())
        if d[i] > tol:
            keep[a + 1 + i] = True
            todo += [(a, a + 1 + i), (a + 1 + i, b)]
    return np.flatnonzero(keep)


def simplify(ring_col, tol: float):
    """Simplified closed ring; a ring that would lose its area is left as it is."""
    @F.pandas_udf(RING)
    def run(s: pd.Series) -> pd.Series:
        def one(ring):
            pts = np.array([(p["x"], p["y"]) for p in ring], float)
            if len(pts) < 5:
                return [{"x": x, "y": y} for x, y in pts]
            far = int(np.hypot(*(pts - pts[0]).T).argmax())
            idx = np.concatenate([_simplify(pts[:far + 1], tol), far + _simplify(pts[far:], tol)[1:]])
            out = pts[idx] if len(idx) >= 4 else pts
            return [{"x": x, "y": y} for x, y in out]
        return s.map(one)
    return run(ring_col)


def polygons(labelled: DataFrame, catalog: DataFrame, gsd: float, min_px: int | dict[int, int], tol: float | None = None) -> DataFrame:
    """Polygon rows: outer ring and holes as world rings, area, perimeter.

    ``min_px`` may differ per class. The threshold is applied before
    simplification. A polygon is one value of one row, as any geometry is.
    """
    labelled = durable(labelled)
    m = durable(large_enough(boundary_measures(labelled, gsd), min_px))
    v = rings(labelled.join(m.select("raster_id", "comp_id"), ["raster_id", "comp_id"], "left_semi"))
    dims = catalog.select("raster_id", "gt_a", "gt_c", "gt_e", "gt_f")
    v = v.join(dims, "raster_id").withColumn("p", F.struct((F.col("gt_c") + F.col("gt_a") * F.col("x")).alias("x"), (F.col("gt_f") + F.col("gt_e") * F.col("y")).alias("y")))
    per = v.groupBy("raster_id", "comp_id", "ring_id").agg(F.sort_array(F.collect_list(F.struct("pos", "p"))).alias("s")).withColumn(
        "ring", F.transform("s", lambda t: t["p"])).withColumn("ring", F.concat("ring", F.slice("ring", 1, 1)))
    if tol is None:
        tol = gsd * 0.5
    if tol > 0:
        per = per.withColumn("ring", simplify(F.col("ring"), tol))
    poly = per.groupBy("raster_id", "comp_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ring_id", "ring"))), lambda t: t["ring"]).alias("rings"))
    return m.join(poly, ["raster_id", "comp_id"])


def large_enough(measures: DataFrame, min_px: int | dict[int, int]) -> DataFrame:
    if isinstance(min_px, int):
        return measures.filter(F.col("area_px") >= min_px)
    need = F.coalesce(*[F.when(F.col("class_id") == k, v) for k, v in min_px.items()])
    return measures.filter(F.col("area_px") >= need)


def min_area_box(labelled: DataFrame, gsd: float = 1.0) -> DataFrame:
    """Smallest enclosing rectangle of each component (rotating calipers on its hull).

    Only the outermost corners of each row are needed, so a group has at most
    four points per raster row.
    """
    ext = labelled.groupBy("raster_id", "comp_id", "row").agg(F.min("c0").alias("a"), (F.max("c1") + 1).alias("z"))

    def box(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf["row"].to_numpy(float)
        a, z = pdf["a"].to_numpy(float), pdf["z"].to_numpy(float)
        pts = sorted(set(zip(np.concatenate([a, a, z, z]), np.concatenate([r, r + 1, r, r + 1]))))

        def half(ps):
            h = []
            for p in ps:
                while len(h) > 1 and (h[-1][0] - h[-2][0]) * (p[1] - h[-2][1]) - (h[-1][1] - h[-2][1]) * (p[0] - h[-2][0]) <= 0:
                    h.pop()
                h.append(p)
            return h
        hull = np.array(half(pts)[:-1] + half(pts[::-1])[:-1])
        e = np.roll(hull, -1, axis=0) - hull
        ang = np.unique(np.round(np.mod(np.arctan2(e[:, 1], e[:, 0]), np.pi / 2), 12))
        best = min(((np.ptp(hull @ [math.cos(t), math.sin(t)]), np.ptp(hull @ [-math.sin(t), math.cos(t)]), t) for t in ang), key=lambda b: b[0] * b[1])
        w, h, t = best
        return pd.DataFrame({"raster_id": [pdf["raster_id"].iloc[0]], "comp_id": [pdf["comp_id"].iloc[0]],
                             "width": [min(w, h) * gsd], "height": [max(w, h) * gsd], "angle_deg": [math.degrees(t)]})

    return ext.groupBy("raster_id", "comp_id").applyInPandas(box, "raster_id long, comp_id long, width double, height double, angle_deg double")
