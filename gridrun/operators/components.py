"""Connected components of run layers.

Runs are cut at square tiles; each tile is labelled on its own (a tile bounds
the group whatever the raster holds), then only the labels that touch across
tile borders are merged by alternating star contraction (Kiveris et al., 2014).
A component's id is ``row * stride + c0`` of its first run, so ids need no
coordination between tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridrun.operators.runs import join_touching, run_len
from gridrun.operators.strips import STRIP, boxes_of, grouped, laid_over, lines_of, numbers
from gridrun.session import durable, stored

TILE = 512


def _tile_labels(cls, row, c0, c1, reach: int):
    """Smallest member index per run; runs sorted by (cls, row, c0).

    Neighbouring runs are found by binary search, labels spread by repeated
    minimum with pointer jumping.
    """
    n = len(row)
    span = int(c1.max()) + 4
    line = (cls.astype(np.int64) * (int(row.max()) + 3) + row) * span + 1
    starts, ends = line + c0, line + c1
    nxt = line + span
    lo = np.searchsorted(ends, nxt + c0 - reach, "left")
    hi = np.searchsorted(starts, nxt + c1 + reach, "right")
    # Runs that touch in the same row only arise from tile cuts; link them too.
    same = np.flatnonzero((line[1:] == line[:-1]) & (c0[1:] == c1[:-1] + 1))
    cnt = np.maximum(hi - lo, 0)
    a = np.repeat(np.arange(n), cnt)
    b = np.arange(cnt.sum()) - np.repeat(np.cumsum(cnt) - cnt, cnt) + np.repeat(lo, cnt)
    a, b = np.concatenate([a, same]), np.concatenate([b, same + 1])
    lab = np.arange(n)
    while len(a):
        la, lb = lab[a], lab[b]
        low = np.minimum(la, lb)
        np.minimum.at(lab, la, low)
        np.minimum.at(lab, lb, low)
        lab = lab[lab]
        while True:
            jump = lab[lab]
            if (jump == lab).all():
                break
            lab = jump
        keep = lab[a] != lab[b]
        a, b = a[keep], b[keep]
    return lab


def _in_tiles(t: pa.Table, starts: np.ndarray, stride: int, reach: int) -> tuple[np.ndarray, ...]:
    """Runs of some tiles in order, with the label of each: order, tile, class, row, first and last column, label."""
    cls, row, c0, c1 = (t.column(c).to_numpy().astype(np.int64) for c in ("class_id", "row", "c0", "c1"))
    return _labelled(numbers(starts, t.num_rows), cls, row, c0, c1, stride, reach)


def _labelled(group, cls, row, c0, c1, stride: int, reach: int) -> tuple[np.ndarray, ...]:
    order = np.lexsort((c0, row, cls, group))
    group, cls, row, c0, c1 = group[order], cls[order], row[order], c0[order], c1[order]
    if not len(row):
        return order, group, cls, row, c0, c1, row
    new = np.append(True, group[1:] != group[:-1])
    top = row[new].copy()                                          # a tile's own rows, so that places stay small
    np.minimum.at(top, np.cumsum(new) - 1, row)
    of = np.cumsum(new | np.append(True, cls[1:] != cls[:-1])) - 1
    lab = _tile_labels(of, row - top[np.cumsum(new) - 1], c0, c1, reach)
    return order, group, cls, row, c0, c1, row[lab] * stride + c0[lab]


def _cut(runs: DataFrame, tile: int) -> DataFrame:
    t = F.col("tc")
    return (
        runs.withColumn("tr", F.floor(F.col("row") / tile).cast("int"))
        .withColumn("tc", F.explode(F.sequence(F.floor(F.col("c0") / tile), F.floor(F.col("c1") / tile))))
        .withColumn("tc", t.cast("int"))
        .withColumn("c0", F.greatest(F.col("c0"), t * tile))
        .withColumn("c1", F.least(F.col("c1"), t * tile + tile - 1))
    )


def label_components(runs: DataFrame, frame: tuple[int, int], stride: int | None = None,
                     connectivity: int = 8, tile: int = TILE) -> DataFrame:
    """Runs ``(raster_id, class_id, row, c0, c1)`` -> the same plus ``comp_id``.

    ``frame`` is the largest (width, height) of any raster; when it fits one
    tile nothing can cross a border and no merge round is planned.
    """
    stride = stride or frame[0]
    reach = 1 if connectivity == 8 else 0
    pieces = _cut(runs.select("raster_id", "class_id", "row", "c0", "c1"), tile)

    def label(t: pa.Table, starts: np.ndarray) -> pa.Table:
        order, _, cls, row, c0, c1, lab = _in_tiles(t, starts, stride, reach)
        raster, tr, tc = (t.column(c).take(pa.array(order)) for c in ("raster_id", "tr", "tc"))
        return pa.table({"raster_id": raster.cast(pa.int64()), "class_id": cls.astype(np.int32), "tr": tr, "tc": tc,
                         "row": row.astype(np.int32), "c0": c0.astype(np.int32), "c1": c1.astype(np.int32), "label": lab})

    labelled = grouped(pieces, ["raster_id", "tr", "tc"], label, "raster_id long, class_id int, tr int, tc int, row int, c0 int, c1 int, label long")
    if frame[0] <= tile and frame[1] <= tile:
        return labelled.withColumnRenamed("label", "comp_id").drop("tr", "tc")
    labelled = stored(labelled)
    roots = contract(border_links(labelled, tile, reach))
    return (
        labelled.join(roots.withColumnRenamed("node", "label"), ["raster_id", "class_id", "label"], "left")
        .withColumn("comp_id", F.coalesce("root", "label")).drop("root", "label", "tr", "tc")
    )


MEASURES = "area_px long, x0 int, y0 int, x1 int, y1 int, sx2 long, sy long"


FOUND = f"raster_id long, class_id int, label long, tr int, tc int, row int, c0 int, c1 int, {MEASURES}"


def _sums_and_border(t: pa.Table, starts, group, cls, row, c0, c1, lab, border) -> pa.Table:
    """Sums of each label of a tile, then the runs on its border, in the columns of ``FOUND``."""
    order = np.lexsort((lab, cls, group))
    gr, cl, la = group[order], cls[order], lab[order]
    first = np.flatnonzero(np.append(True, (gr[1:] != gr[:-1]) | (cl[1:] != cl[:-1]) | (la[1:] != la[:-1]))[: len(gr)])
    n = (c1 - c0 + 1)[order]
    over = lambda f, x: f.reduceat(x, first) if len(first) else x
    sums = {"class_id": cl[first], "label": la[first], "area_px": over(np.add, n), "x0": over(np.minimum, c0[order]), "y0": over(np.minimum, row[order]),
            "x1": over(np.maximum, c1[order]), "y1": over(np.maximum, row[order]), "sx2": over(np.add, (c0 + c1)[order] * n), "sy": over(np.add, row[order] * n)}
    edge = {"class_id": cls[border], "label": lab[border], "row": row[border], "c0": c0[border], "c1": c1[border]}
    at = pa.array(starts[np.concatenate([gr[first], group[border]])])
    out = {"raster_id": t.column("raster_id").take(at).cast(pa.int64())}
    for c in ("class_id", "label", "tr", "tc", "row", "c0", "c1", "area_px", "x0", "y0", "x1", "y1", "sx2", "sy"):
        if c in ("tr", "tc"):
            out[c] = t.column(c).take(at).cast(pa.int32())
            continue
        kind = pa.int64() if c in ("label", "area_px", "sx2", "sy") else pa.int32()
        out[c] = pa.chunked_array([pa.array(part[c]).cast(kind) if c in part else pa.nulls(size, kind) for part, size in ((sums, len(first)), (edge, int(border.sum())))])
    return pa.table(out)


def stats_of_runs(runs: DataFrame, frame: tuple[int, int], stride: int | None = None, connectivity: int = 8, tile: int = TILE) -> DataFrame:
    """``component_stats(label_components(...))`` without the labelled runs.

    A tile sums up its own components; only these sums and the runs on its border leave it, so what is stored and joined
    grows with the components, not with the runs.
    """
    stride = stride or frame[0]
    reach = 1 if connectivity == 8 else 0
    single = frame[0] <= tile and frame[1] <= tile

    def summed(t: pa.Table, starts: np.ndarray) -> pa.Table:
        order, group, cls, row, c0, c1, lab = _in_tiles(t, starts, stride, reach)
        b = np.zeros(len(row), bool) if single else (row % tile == tile - 1) | (row % tile == 0) | (c0 % tile == 0) | (c1 % tile == tile - 1)
        return _sums_and_border(t, starts, group, cls, row, c0, c1, lab, b)

    pieces = _cut(runs.select("raster_id", "class_id", "row", "c0", "c1"), tile)
    found = grouped(pieces, ["raster_id", "tr", "tc"], summed, FOUND)
    return _merged(found, tile, reach, single)


def stats_of_boxes(boxes: DataFrame, frame: tuple[int, int], stride: int | None = None, connectivity: int = 8, strip: int = STRIP) -> DataFrame:
    """``stats_of_runs`` of burned boxes ``(raster_id, r0, r1, c0, c1, value)``; see ``burn.box_layer``.

    A strip of rows is burned and its components are summed up in the same task: boxes cross the shuffle, and of the
    runs only those in the first and last row of a strip. A group is bounded by the raster's width, as in burning.
    """
    stride = stride or frame[0]
    reach = 1 if connectivity == 8 else 0
    single = frame[1] <= strip
    every, _, _ = boxes_of({"class_id": boxes}, strip)
    every = every.withColumn("tr", F.col("strip").cast("int")).withColumn("tc", F.lit(0))

    def summed(t: pa.Table, starts: np.ndarray) -> pa.Table:
        group, runs = laid_over(["class_id"], ("class_id",), strip, t, starts)
        _, group, cls, row, c0, c1, lab = _labelled(group, *(np.asarray(runs[c]).astype(np.int64) for c in ("class_id", "row", "c0", "c1")), stride, reach)
        b = np.zeros(len(row), bool) if single else (row % strip == 0) | (row % strip == strip - 1)
        return _sums_and_border(t, starts, group, cls, row, c0, c1, lab, b)

    return _merged(grouped(every, ["raster_id", "strip"], summed, FOUND, lines_of), strip, reach, single)


def large_of_boxes(boxes: DataFrame, frame: tuple[int, int], min_px: int, stride: int | None = None, connectivity: int = 8, strip: int = STRIP) -> DataFrame:
    """``mask_of(keep_components(label_components(burn_boxes(...)), min_px))`` strip by strip, from boxes ``(raster_id, r0, r1, c0, c1, value)``.

    A first pass sums up the components that touch the border of a strip, and only these leave it; of those that are large
    together, the parts that are small on their own are named to the second pass, which burns and labels the strips once
    more and drops what is small. Runs cross no shuffle.
    """
    stride = stride or frame[0]
    reach = 1 if connectivity == 8 else 0
    every, id_type, _ = boxes_of({"class_id": boxes}, strip)

    def labelled(t: pa.Table, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        group, runs = laid_over(["class_id"], ("class_id",), strip, t, starts)
        return _labelled(group, *(np.asarray(runs[c]).astype(np.int64) for c in ("class_id", "row", "c0", "c1")), stride, reach)[1:]

    def at_border(t: pa.Table, starts: np.ndarray) -> pa.Table:
        group, cls, row, c0, c1, lab = labelled(t, starts)
        b = (row % strip == 0) | (row % strip == strip - 1)
        part = group * (int(lab.max(initial=0)) + 1) + lab
        on = np.isin(part, part[b])
        return _sums_and_border(t, starts, *(v[on] for v in (group, cls, row, c0, c1, lab, b)))

    whole = every.filter("raster_id is not null").select("raster_id", F.col("strip").cast("int").alias("strip"), "r0", "r1", "c0", "c1", "v_class_id", "layer")
    extra = None
    if frame[1] > strip:
        found = stored(grouped(whole.withColumn("tr", F.col("strip")).withColumn("tc", F.lit(0)), ["raster_id", "strip"], at_border, FOUND, lines_of))
        k = ["raster_id", "class_id"]
        roots = contract(border_links(found.filter("row is not null"), strip, reach))
        linked = roots.unionByName(roots.select(*k, F.col("root").alias("node"), "root").distinct())
        parts = found.filter("row is null").select(*k, "label", F.col("tr").alias("strip"), "area_px").join(linked.withColumnRenamed("node", "label"), [*k, "label"])
        large = parts.groupBy(*k, "root").agg(F.sum("area_px").alias("px")).filter(F.col("px") >= min_px).drop("px")
        extra = parts.filter(F.col("area_px") < min_px).join(large, [*k, "root"], "left_semi").select("raster_id", "strip", F.lit(1).alias("layer"), F.col("class_id").alias("v_class_id"), "label")
        # A part goes in as its label, with rows and columns that hold nothing.
        extra = extra.select("raster_id", "strip", *[F.lit(0).alias(c) for c in ("r0", "r1", "c0", "c1")], "v_class_id", "layer", "label")

    def kept(t: pa.Table, starts: np.ndarray) -> pa.Table:
        of = numbers(starts, t.num_rows)
        box = t.column("layer").to_numpy() == 0
        burned = t.filter(pa.array(box))
        first = np.searchsorted(of[box], np.arange(len(starts)))       # the place of each strip's boxes
        own = np.unique(of[box])
        group, cls, row, c0, c1, lab = labelled(burned, first[own])
        group = own[group]
        code = np.append(lab, t.column("label").to_numpy(zero_copy_only=False)[~box].astype(np.int64))
        _, part = np.unique(np.append(group, of[~box]) * (int(code.max(initial=0)) + 1) + code, return_inverse=True)
        part, named = part[: len(lab)], part[len(lab) :]
        area = np.bincount(part, c1 - c0 + 1) if len(part) else np.zeros(0)
        on = np.flatnonzero((area[part] >= min_px) | np.isin(part, named)) if len(part) else part
        return pa.table({"raster_id": t.column("raster_id").take(pa.array(starts[group[on]])), "row": pa.array(row[on].astype(np.int32)),
                         "c0": pa.array(c0[on].astype(np.int32)), "c1": pa.array(c1[on].astype(np.int32)), "class_id": pa.array(cls[on].astype(np.int32))})

    whole = whole.withColumn("label", F.lit(None).cast("long"))
    whole = whole if extra is None else whole.unionByName(extra)
    return grouped(whole, ["raster_id", "strip"], kept, f"raster_id {id_type}, row int, c0 int, c1 int, class_id int", lines_of)


def _merged(found: DataFrame, tile: int, reach: int, single: bool) -> DataFrame:
    """Sums of labels and border runs -> measures of components."""
    if not single:
        found = stored(found)
        roots = contract(border_links(found.filter("row is not null"), tile, reach))
        found = found.filter("row is null").join(roots.withColumnRenamed("node", "label"), ["raster_id", "class_id", "label"], "left").withColumn(
            "label", F.coalesce("root", "label"))
    return _measured(found.withColumnRenamed("label", "comp_id").groupBy("raster_id", "class_id", "comp_id").agg(
        F.sum("area_px").alias("area_px"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.sum("sx2").alias("_sx2"), F.sum("sy").alias("_sy")))


def border_links(labelled: DataFrame, tile: int, reach: int) -> DataFrame:
    """Pairs of labels that touch across a tile border.

    Both joins are equi-joins on a border cell, so a key never holds more than
    the few runs at that spot.
    """
    k = ["raster_id", "class_id"]
    # Across horizontal borders: last row of a tile against the next row, per column tile (a run of a strip may meet several).
    up = labelled.filter(F.col("row") % tile == tile - 1).select(
        *k, (F.col("row") + 1).alias("row"), "label", "c0", "c1",
        F.explode(F.sequence(F.floor((F.col("c0") - reach) / tile), F.floor((F.col("c1") + reach) / tile))).alias("tc"))
    down = labelled.filter(F.col("row") % tile == 0).select(
        *k, "row", F.explode(F.sequence(F.floor(F.col("c0") / tile), F.floor(F.col("c1") / tile))).alias("tc"),
        F.col("label").alias("label2"), F.col("c0").alias("d0"), F.col("c1").alias("d1"))
    vert = up.join(down, [*k, "row", "tc"]).filter(
        (F.col("d0") <= F.col("c1") + reach) & (F.col("d1") >= F.col("c0") - reach))
    # Across vertical borders: run ending at the border against the neighbour starting there.
    left = labelled.filter(F.col("c1") % tile == tile - 1).select(
        *k, (F.col("c1") + 1).alias("c0"), "label",
        F.explode(F.sequence(F.col("row") - reach, F.col("row") + reach)).alias("row"))
    right = labelled.filter(F.col("c0") % tile == 0).select(*k, "c0", "row", F.col("label").alias("label2"))
    horiz = left.join(right, [*k, "row", "c0"])
    return vert.select(*k, "label", "label2").unionByName(horiz.select(*k, "label", "label2")).filter(
        "label <> label2").distinct()


def contract(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Undirected links -> ``(raster_id, class_id, node, root)``, root = smallest node reached.

    Large-star then small-star until nothing changes; rounds grow with the log
    of the longest chain. The minimum per node is a plain aggregate joined back,
    so a hub with a huge number of neighbours is never collected.
    """
    k = ["raster_id", "class_id"]
    e = durable(links.select(*k, F.greatest("label", "label2").alias("u"), F.least("label", "label2").alias("v")).distinct())
    for _ in range(max_rounds):
        both = e.unionByName(e.select(*k, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(*k, "u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.filter("v > u").join(low, [*k, "u"]).select(*k, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low2 = large.groupBy(*k, "u").agg(F.min("v").alias("m"))
        small = large.join(low2, [*k, "u"])
        nxt = durable(
            small.select(*k, F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
                low2.select(*k, "u", F.col("m").alias("v"))).filter("u <> v").distinct())
        if nxt.exceptAll(e).isEmpty() and e.exceptAll(nxt).isEmpty():
            return nxt.select(*k, F.col("u").alias("node"), F.col("v").alias("root"))
        e = nxt
    raise RuntimeError("label contraction did not settle")


def component_stats(labelled: DataFrame) -> DataFrame:
    """Area, half-open box sides and centroid (mean of pixel centres) per component."""
    n = run_len()
    return _measured(labelled.groupBy("raster_id", "class_id", "comp_id").agg(
        F.sum(n).alias("area_px"), F.min("c0").alias("x0"), F.min("row").alias("y0"),
        F.max("c1").alias("x1"), F.max("row").alias("y1"),
        F.sum((F.col("c0") + F.col("c1")) * n).alias("_sx2"), F.sum(F.col("row") * n).alias("_sy")))


def _measured(sums: DataFrame) -> DataFrame:
    return sums.select(
        "raster_id", "class_id", "comp_id", "area_px", "x0", "y0", "x1", "y1",
        (F.col("x1") - F.col("x0") + 1).alias("bw"), (F.col("y1") - F.col("y0") + 1).alias("bh"),
        (F.col("_sx2") / 2.0 / F.col("area_px")).alias("cx"), (F.col("_sy").cast("double") / F.col("area_px")).alias("cy"))


def keep_components(labelled: DataFrame, min_px: int = 0, max_px: int | None = None) -> DataFrame:
    """Runs of components whose area lies in the range."""
    area = labelled.groupBy("raster_id", "class_id", "comp_id").agg(F.sum(run_len()).alias("area_px"))
    ok = F.col("area_px") >= min_px
    if max_px is not None:
        ok = ok & (F.col("area_px") <= max_px)
    return labelled.join(area.filter(ok).drop("area_px"), ["raster_id", "class_id", "comp_id"], "left_semi")


def mask_of(labelled: DataFrame) -> DataFrame:
    """Labelled runs as a class mask of maximal runs: pieces that a tile border parts are one run again."""
    return join_touching(labelled.select("raster_id", "row", "c0", "c1", "class_id"))


def aspect():
    return F.greatest("bw", "bh") / F.greatest(F.least("bw", "bh"), F.lit(1)).cast("double")


def fill():
    return F.col("area_px") / F.greatest(F.col("bw").cast("long") * F.col("bh"), F.lit(1)).cast("double")
