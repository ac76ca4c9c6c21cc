"""Vector layers -> class runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridrun.operators.runs import ROW, _constant_runs, _edges
from gridrun.operators.strips import STRIP, _lines, boxes_of, grouped, in_strips, laid_over, lay_over, lines_of, numbers


def burn_runs(scan: DataFrame, classes=(1, 2, 3, 4)) -> DataFrame:
    """Overlapping runs ``(raster_id, row, c0, c1, class_id)`` -> class mask.

    Where runs overlap the lowest class id wins. Breakpoints are summed before
    the shuffle, so features piling up on one raster shrink to at most one
    breakpoint per column of a row.
    """
    ev = _edges(scan, list(ROW), ("class_id",))
    agg = ev.groupBy(*ROW, "pos").agg(
        *[F.sum(F.when(F.col("class_id") == k, F.col("d")).otherwise(0)).alias(f"d{k}") for k in classes])
    w = Window.partitionBy(*ROW).orderBy("pos")
    top = F.coalesce(*[F.when(F.sum(f"d{k}").over(w) > 0, k) for k in classes])
    return _constant_runs(agg.select(*ROW, "pos", top.cast("int").alias("class_id")), list(ROW), ["class_id"])


def box_runs(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """Pixel boxes ``(raster_id, class_id, c0, r0, w, h)`` -> clipped runs."""
    return boxes.select(
        "raster_id", "class_id",
        F.explode(F.sequence(F.greatest(F.col("r0"), F.lit(0)),
                             F.least(F.col("r0") + F.col("h") - 1, F.lit(height - 1)))).alias("row"),
        F.greatest(F.col("c0"), F.lit(0)).alias("c0"),
        F.least(F.col("c0") + F.col("w") - 1, F.lit(width - 1)).alias("c1"),
    ).filter("c1 >= c0")


def box_layer(boxes: DataFrame, width: int, height: int, classes=(1, 2, 3, 4)) -> DataFrame:
    """Pixel boxes ``(raster_id, class_id, c0, r0, w, h)`` cut to the frame, as a layer of ``lay_over``."""
    top, bottom = F.greatest(F.col("r0"), F.lit(0)), F.least(F.col("r0") + F.col("h") - 1, F.lit(height - 1))
    return boxes.filter(F.col("class_id").isin(*classes)).select(
        "raster_id", F.least(top, bottom).alias("r0"), F.greatest(top, bottom).alias("r1"),
        F.greatest(F.col("c0"), F.lit(0)).alias("c0"), F.least(F.col("c0") + F.col("w") - 1, F.lit(width - 1)).alias("c1"),
        F.col("class_id").alias("value")).filter("c1 >= c0")


def burn_boxes(boxes: DataFrame, width: int, height: int, classes=(1, 2, 3, 4)) -> DataFrame:
    """``burn_runs(box_runs(...))``, strip by strip: boxes are shuffled, not the ends of their runs."""
    return lay_over({"class_id": box_layer(boxes, width, height, classes)}, ("class_id",))


#: Pixels decoded at once.
PIXELS_AT_ONCE = 4_000_000


def _coded(line: np.ndarray, c0: np.ndarray, c1: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of one class -> their pixels -> maximal runs of these: line, first and last column."""
    out = []
    wide = int(c1.max()) + 2 if len(c1) else 2
    # As many whole lines at once as hold so many pixels.
    portion = np.cumsum(c1 - c0 + 1) // PIXELS_AT_ONCE
    new = np.flatnonzero(np.append(True, line[1:] != line[:-1])[: len(line)])
    cut = np.append(new[np.append(True, portion[new][1:] != portion[new][:-1])[: len(new)]], len(line))
    for a, z in zip(cut[:-1], cut[1:], strict=True):
        n = (c1 - c0 + 1)[a:z]
        pixel = np.arange(n.sum()) + np.repeat(line[a:z] * wide + c0[a:z] - np.cumsum(n) + n, n)
        if (pixel[1:] < pixel[:-1]).any():
            pixel.sort()
        first = np.flatnonzero(np.append(True, pixel[1:] != pixel[:-1] + 1))
        last = pixel[np.append(first[1:], len(pixel)) - 1]
        of, col = np.divmod(pixel[first], wide)
        out.append((of, col, last - of * wide))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (line, c0, c1)


def recoded_boxes(boxes: DataFrame, width: int, height: int, classes=(1, 2, 3, 4), strip: int = STRIP) -> DataFrame:
    """``encode(decode(burn_boxes(...)))``, strip by strip: every pixel is made and put into its run again in the task that burned it.

    A row of a raster is in one strip, so neither runs nor pixels cross a shuffle; pixels are held ``PIXELS_AT_ONCE`` at a time.
    """
    every, id_type, _ = boxes_of({"class_id": box_layer(boxes, width, height, classes)}, strip)

    def recoded(t: pa.Table, starts: np.ndarray) -> pa.Table:
        group, runs = laid_over(["class_id"], ("class_id",), strip, t, starts)
        cls, row, c0, c1 = (np.asarray(runs[c]).astype(np.int64) for c in ("class_id", "row", "c0", "c1"))
        line = group * strip + row % strip
        parts = [(k, *_coded(line[cls == k], c0[cls == k], c1[cls == k])) for k in classes]
        line, left, right = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
        g = line // strip
        top = t.column("strip").to_numpy()[starts].astype(np.int64) * strip
        return pa.table({"raster_id": t.column("raster_id").take(pa.array(starts[g])), "class_id": pa.array(np.repeat([k for k, *_ in parts], [len(p[1]) for p in parts]).astype(np.int32)),
                         "row": pa.array((line % strip + top[g]).astype(np.int32)), "c0": pa.array(left.astype(np.int32)), "c1": pa.array(right.astype(np.int32))})

    return grouped(every, ["raster_id", "strip"], recoded, f"raster_id {id_type}, class_id int, row int, c0 int, c1 int", lines_of)


def scan_rings(features: DataFrame, catalog: DataFrame) -> DataFrame:
    """Scanline fill of world rings by pixel centre (even-odd rule).

    ``features`` has ``raster_id, feature_id, class_id, rings``. Ring edges are
    spread over the rows whose centre line they cross; crossings are paired
    inside one (feature, row), so a group never exceeds one feature's row.
    """
    dims = catalog.select("raster_id", "gt_a", "gt_c", "gt_e", "gt_f", "width", "height")
    ring = F.col("ring")
    edges = (
        features.join(dims, "raster_id")
        .select("raster_id", "feature_id", "class_id", "width", "height", "gt_a", "gt_c", "gt_e", "gt_f",
                F.explode("rings").alias("ring"))
        .filter(F.size(ring) >= 2)
        .select("*", F.explode(F.sequence(F.lit(0), F.size(ring) - 2)).alias("i"))
        .select("raster_id", "feature_id", "class_id", "width", "height",
                ((ring[F.col("i")]["x"] - F.col("gt_c")) / F.col("gt_a")).alias("x0"),
                ((ring[F.col("i")]["y"] - F.col("gt_f")) / F.col("gt_e")).alias("y0"),
                ((ring[F.col("i") + 1]["x"] - F.col("gt_c")) / F.col("gt_a")).alias("x1"),
                ((ring[F.col("i") + 1]["y"] - F.col("gt_f")) / F.col("gt_e")).alias("y1"))
        .filter("y0 <> y1")
    )
    lo, hi = F.least("y0", "y1"), F.greatest("y0", "y1")
    first = F.greatest(F.ceil(lo - 0.5), F.lit(0)).cast("int")
    last = F.least(F.ceil(hi - 0.5) - 1, F.col("height") - 1).cast("int")
    cross = (
        edges.withColumn("a", first).withColumn("b", last).filter("a <= b")
        .select("*", F.explode(F.sequence("a", "b")).alias("row"))
        .withColumn("x", F.col("x0") + (F.col("row") + 0.5 - F.col("y0"))
                    * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0")))
    )
    w = Window.partitionBy("raster_id", "feature_id", "row").orderBy("x")
    return (
        cross.withColumn("n", F.row_number().over(w)).withColumn("x2", F.lead("x").over(w))
        .filter("n % 2 = 1 and x2 is not null")
        .select("raster_id", "feature_id", "class_id", "row",
                F.greatest(F.ceil(F.col("x") - 0.5), F.lit(0)).cast("int").alias("c0"),
                F.least(F.ceil(F.col("x2") - 0.5) - 1, F.col("width") - 1).cast("int").alias("c1"))
        .filter("c0 <= c1")
    )


#: Rows of features scanned at once.
AT_ONCE = 1_000_000

#: Last column of a run that nothing ends.
OPEN = np.iinfo(np.int32).max


def _paired(key: np.ndarray, pos: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, ...]:
    """Crossings of lines ``key`` -> stretches from each odd one to the next: key, first and last column, tag of the first; ``OPEN`` if none is left."""
    order = np.lexsort((pos, key))
    key, pos, tag = key[order], pos[order], tag[order]
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    nth = np.arange(len(key)) - new[numbers(new, len(key))] if len(key) else np.zeros(0, np.int64)
    odd = np.flatnonzero(nth % 2 == 0)
    nxt = np.minimum(odd + 1, max(len(key) - 1, 0))
    closed = (nxt > odd) & (key[nxt] == key[odd])
    last = np.where(closed, pos[nxt] - 1, OPEN)
    keep = pos[odd] <= last
    return key[odd][keep], pos[odd][keep], last[keep], tag[odd][keep]


def _tall(t: pa.Table) -> np.ndarray:
    """Rows that the edges of each feature cross, about."""
    rings = t.column("rings").combine_chunks()
    points = pc.list_flatten(rings)
    feature = pc.list_parent_indices(rings).to_numpy()[pc.list_parent_indices(points).to_numpy()]
    y = pc.fill_null(pc.struct_field(pc.list_flatten(points), "y"), 0.0).to_numpy(zero_copy_only=False)
    step = np.nan_to_num(np.abs(np.diff(y)) / np.abs(t.column("gt_e").to_numpy()[feature[1:]]) * (feature[1:] == feature[:-1]), posinf=0)
    return np.bincount(feature[1:], np.minimum(step, t.column("height").to_numpy()[feature[1:]]), t.num_rows)


def _scanned(t: pa.Table) -> pa.Table:
    """Features with their raster's affine -> boxes of their own even-odd fill, in the frame but for an open end."""
    rings = t.column("rings").combine_chunks() if isinstance(t.column("rings"), pa.ChunkedArray) else t.column("rings")
    ring, points = pc.list_parent_indices(rings).to_numpy(), pc.list_flatten(rings)
    feature = ring[pc.list_parent_indices(points).to_numpy()]
    of_ring, points = pc.list_parent_indices(points).to_numpy(), pc.list_flatten(points)
    a, c, e, f = (t.column(n).to_numpy().astype(float) for n in ("gt_a", "gt_c", "gt_e", "gt_f"))
    at = lambda n: pc.fill_null(pc.struct_field(points, n), np.nan).to_numpy(zero_copy_only=False)
    x, y = (at("x") - c[feature]) / a[feature], (at("y") - f[feature]) / e[feature]
    i = np.flatnonzero((of_ring[1:] == of_ring[:-1]) & (y[1:] != y[:-1]) & ~np.isnan(x[1:] + x[:-1] + y[1:] + y[:-1]))
    feature, x0, y0, x1, y1 = feature[i], x[i], y[i], x[i + 1], y[i + 1]
    width, height = (t.column(n).to_numpy().astype(np.int64) for n in ("width", "height"))
    first = np.maximum(np.ceil(np.minimum(y0, y1) - 0.5), 0).astype(np.int64)
    last = np.minimum(np.ceil(np.maximum(y0, y1) - 0.5) - 1, height[feature] - 1).astype(np.int64)
    keep = np.flatnonzero(first <= last)
    feature, x0, y0, x1, y1, first, last = (v[keep] for v in (feature, x0, y0, x1, y1, first, last))
    n = last - first + 1
    k = np.repeat(np.arange(len(n)), n)
    row = np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n) + first[k]
    cross = x0[k] + (row + 0.5 - y0[k]) * (x1 - x0)[k] / (y1 - y0)[k]
    tall = int(row.max()) + 1 if len(row) else 1
    key, c0, c1, _ = _paired(feature[k] * tall + row, np.ceil(cross - 0.5).astype(np.int64), feature[k])
    feature, row = np.divmod(key, tall)
    c0, c1 = np.clip(c0, 0, width[feature]), np.where(c1 == OPEN, c1, np.minimum(c1, width[feature] - 1))
    keep = np.flatnonzero(c0 <= c1)
    feature, row, c0, c1 = (v[keep] for v in (feature, row, c0, c1))
    order = np.lexsort((row, c1, c0, feature))
    feature, row, c0, c1 = (v[order] for v in (feature, row, c0, c1))
    new = np.append(True, (feature[1:] != feature[:-1]) | (c0[1:] != c0[:-1]) | (c1[1:] != c1[:-1]) | (row[1:] != row[:-1] + 1))[: len(row)]
    top = np.flatnonzero(new)
    bottom = np.append(top[1:], len(row))[: len(top)] - 1
    mine = pa.array(feature[top])
    return pa.table({**{n: t.column(n).take(mine) for n in ("raster_id", "feature_id", "class_id")}, **{n: pa.array(v.astype(np.int32)) for n, v in (
        ("r0", row[top]), ("r1", row[bottom]), ("c0", c0[top]), ("c1", c1[top]))}})


def _even_odd(t: pa.Table, starts: np.ndarray, strip: int, classes) -> tuple[pa.Table, np.ndarray]:
    """Boxes of features in strips -> boxes that a burn may lay over each other; crossings of rows of one feature are paired anew."""
    group = numbers(starts, t.num_rows)
    _, fid = np.unique(np.asarray(pc.fill_null(t.column("feature_id"), 0)), return_inverse=True)
    fid = (group * t.num_rows + fid) * 2 + np.asarray(pc.is_valid(t.column("feature_id")))
    _, fid, count = np.unique(fid, return_inverse=True, return_counts=True)
    many = (count[fid] > 1) | (t.column("c1").to_numpy() == OPEN)
    kind = t.column("class_id").fill_null(0).to_numpy().astype(np.int64)
    alone = np.flatnonzero(~many)
    r0, r1, c0, c1 = (t.column(c).to_numpy().astype(np.int64)[alone] for c in ("r0", "r1", "c0", "c1"))
    box = np.flatnonzero(many)
    if len(box):
        i, row, a, z = _lines(t.take(pa.array(box)))
        i, closed = box[i], z != OPEN
        key = fid[i] * strip + row % strip
        key, a, z, i = _paired(np.append(key, key[closed]), np.append(a, z[closed] + 1), np.append(i, i[closed]))
        shut = z != OPEN
        a, z, i, row = a[shut], z[shut], i[shut], (key % strip)[shut] + t.column("strip").to_numpy().astype(np.int64)[i[shut]] * strip
        alone, r0, r1, c0, c1 = np.append(alone, i), np.append(r0, row), np.append(r1, row), np.append(c0, a), np.append(c1, z)
    known = np.isin(kind[alone], list(classes))
    order = np.flatnonzero(known)[np.argsort(group[alone[known]], kind="stable")]
    at = alone[order]
    new = np.flatnonzero(np.append(True, group[at][1:] != group[at][:-1])[: len(at)])
    out = {c: t.column(c).take(pa.array(at)) for c in ("raster_id", "strip")} | {n: pa.array(v[order].astype(np.int32)) for n, v in (("r0", r0), ("r1", r1), ("c0", c0), ("c1", c1))}
    return pa.table(out | {"layer": pa.array(np.zeros(len(at), np.int32)), "v_class_id": pa.chunked_array([pa.array(kind[at].astype(np.int32))])}), new


def burn_rings(features: DataFrame, catalog: DataFrame, classes=(1, 2, 3, 4), strip: int = STRIP) -> DataFrame:
    """``burn_runs(scan_rings(...))``, strip by strip: a feature is scanned in its row and crosses the shuffle as boxes of equal runs.

    Rows of one feature fill by the even-odd rule together, as they do in ``scan_rings``: they meet in their strips, where
    the ends of their boxes are paired anew. The affine of each raster, 64 bytes, goes to every task.
    """
    dims = catalog.select("raster_id", "gt_a", "gt_c", "gt_e", "gt_f", "width", "height")
    d = features.select("raster_id", "feature_id", "class_id", "rings").join(F.broadcast(dims), "raster_id")
    ids = {c: features.schema[c].dataType.simpleString() for c in ("raster_id", "feature_id")}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            portion = np.cumsum(_tall(t)) // AT_ONCE
            cut = np.append(np.flatnonzero(np.append(True, portion[1:] != portion[:-1])[: t.num_rows]), t.num_rows)
            for a, z in zip(cut[:-1], cut[1:], strict=True):
                yield from _scanned(t.slice(a, z - a).combine_chunks()).to_batches()

    boxes = d.mapInArrow(scan, f"raster_id {ids['raster_id']}, feature_id {ids['feature_id']}, class_id int, r0 int, r1 int, c0 int, c1 int")

    def burned(t: pa.Table, starts: np.ndarray) -> pa.Table:
        return pa.table(laid_over(["class_id"], ("class_id",), strip, *_even_odd(t, starts, strip, classes))[1])

    return grouped(in_strips(boxes, strip), ["raster_id", "strip"], burned, f"raster_id {ids['raster_id']}, row int, c0 int, c1 int, class_id int", lines_of)
