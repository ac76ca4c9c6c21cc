"""Summed areas over runs: class pixels of any number of boxes from their corners.

The pixels of a class above and left of a corner (r, c) are the sum of three parts, each from a table that is bounded
by the raster's geometry: whole cells above and left, the rows of the corner's own strip of cells above r, and the
columns of its own strip of cells left of c in the strips above. A box is the signed sum over its four corners, so the
work grows with runs plus boxes, not with their pairs, however many boxes lie over the same runs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridrun.constants import N_CLASSES
from gridrun.operators.strips import grouped, numbers

CLASSES = range(1, N_CLASSES)
PARTS = [f"s{k}" for k in CLASSES]
CORNER = "raster_id long, y int, x int, " + ", ".join(f"{s} long" for s in PARTS)


def _corners(boxes: DataFrame, patch: int, cell: int) -> DataFrame:
    """Four signed corners of each box: ``raster_id, y, x, r, c, sign, br, bc``."""
    at = lambda dy, dx, sign: F.struct((F.col("y") + dy).alias("r"), (F.col("x") + dx).alias("c"), F.lit(sign).alias("sign"))
    d = boxes.select("raster_id", "y", "x", F.explode(F.array(at(0, 0, 1), at(patch, patch, 1), at(0, patch, -1), at(patch, 0, -1))).alias("k")).select("raster_id", "y", "x", "k.*")
    return d.withColumns({"br": F.floor(F.col("r") / cell), "bc": F.floor(F.col("c") / cell)})


def _fresh(df: DataFrame) -> DataFrame:
    """The same rows under columns of their own, so that both sides of a cogroup may come from one table."""
    return df.toDF(*df.columns)


def _emitted(points: pa.Table, sums: np.ndarray) -> pa.Table:
    signed = sums * points.column("sign").to_numpy()[:, None]
    return pa.table([*[points.column(c) for c in ("raster_id", "y", "x")], *[pa.array(signed[:, k].astype(np.int64)) for k in range(len(PARTS))]], names=["raster_id", "y", "x", *PARTS])


def _nothing() -> pa.Table:
    return pa.table({"raster_id": pa.array([], pa.int64()), "y": pa.array([], pa.int32()), "x": pa.array([], pa.int32()), **{s: pa.array([], pa.int64()) for s in PARTS}})


#: Looked-up rows of corners held at once.
AT_ONCE = 1_000_000


def _rows_above(cell: int):
    """Pixels of the strip's rows above each corner and left of it, row by row: starts before c less what runs on past c.

    The corners and runs of many strips are looked up in one call: a run's place is its class, strip, row and first column in one number.
    """

    def lookup(t: pa.Table, starts: np.ndarray) -> pa.Table:
        group, corner = numbers(starts, t.num_rows), np.asarray(pc.is_valid(t.column("sign")))
        points, runs = t.filter(pa.array(corner)), t.filter(pa.array(~corner))
        if not points.num_rows or not runs.num_rows:
            return _nothing()
        r, c = (points.column(n).to_numpy().astype(np.int64) for n in ("r", "c"))
        row, c0, c1, k = (runs.column(n).to_numpy().astype(np.int64) for n in ("row", "c0", "c1", "class_id"))
        lines, span = len(starts) * cell, int(max(c0.max(), c.max())) + 1
        first = group[corner] * cell                                   # line of the first row of a corner's strip
        place = ((k - 1) * lines + group[~corner] * cell + row % cell) * span + c0
        order = np.argsort(place, kind="stable")
        place, end = place[order], c1[order] + 1
        px = np.append(0, np.cumsum(end - c0[order]))
        begin = np.searchsorted(place, np.arange(len(PARTS) * lines) * span)
        out = np.zeros((len(r), len(PARTS)), dtype=np.int64)
        many = max(1, AT_ONCE // cell)
        for at in range(0, len(r), many):
            n = r[at : at + many] % cell
            own = np.repeat(np.arange(len(n)), n)
            line = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + first[at : at + many][own]
            col = c[at : at + many][own]
            for i in range(len(PARTS)):
                a, z = begin[i * lines + line], np.searchsorted(place, (i * lines + line) * span + col)
                over = np.where(z > a, np.maximum(0, end[np.maximum(z, 1) - 1] - col), 0)
                out[at : at + many, i] = np.bincount(own, px[z] - px[a] - over, len(n)).astype(np.int64)
        return _emitted(points, out)

    return lookup


def _columns_left(cell: int):
    """Pixels left of each corner in its own strip of columns, in the strips of rows above: prefix sums by block of rows and column."""

    def lookup(key: tuple, points: pa.Table, runs: pa.Table) -> pa.Table:
        if not points.num_rows or not runs.num_rows:
            return _nothing()
        left = int(key[1].as_py()) * cell
        br, c = points.column("br").to_numpy(), points.column("c").to_numpy() - left
        block, c0, c1, k = runs.column("br").to_numpy(), runs.column("c0").to_numpy() - left, runs.column("c1").to_numpy() - left, runs.column("class_id").to_numpy()
        out = np.zeros((len(br), len(PARTS)), dtype=np.int64)
        blocks = int(max(block.max(), br.max())) + 1
        for i, cls in enumerate(CLASSES):
            mine = k == cls
            if mine.any():
                at = np.zeros((blocks + 1, cell + 2), dtype=np.int64)
                np.add.at(at, (block[mine] + 1, c0[mine] + 1), 1)
                np.add.at(at, (block[mine] + 1, c1[mine] + 2), -1)
                out[:, i] = at.cumsum(axis=1).cumsum(axis=1).cumsum(axis=0)[br, c]
        return _emitted(points, out)

    return lookup


def _cells(pieces: DataFrame, catalog: DataFrame, cell: int) -> DataFrame:
    """``raster_id, br, bc`` and the pixels of all cells above and left of that cell; windows run over one strip of cells each."""
    totals = pieces.groupBy("raster_id", "br", "bc").agg(*[F.sum(F.when(F.col("class_id") == k, F.col("c1") - F.col("c0") + 1).otherwise(0)).cast("long").alias(s) for k, s in zip(CLASSES, PARTS, strict=True)])
    side = lambda v: F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col(v) / cell)))
    grid = catalog.select("raster_id", "width", side("height").alias("br")).select("raster_id", "br", side("width").alias("bc"))
    for along, across in (("bc", "br"), ("br", "bc")):
        w = Window.partitionBy("raster_id", across).orderBy(along).rowsBetween(Window.unboundedPreceding, -1)
        grid = grid.join(totals, ["raster_id", "br", "bc"], "left") if along == "bc" else grid
        grid = grid.select("raster_id", "br", "bc", *[F.coalesce(F.sum(s).over(w), F.lit(0)).alias(s) for s in PARTS])
    return grid


def box_class_px(runs: DataFrame, catalog: DataFrame, boxes: DataFrame, patch: int, cell: int = 64) -> DataFrame:
    """``boxes`` (raster_id, y, x and more; squares of ``patch`` pixels inside their raster) with ``px0`` .. of each class.

    Boxes over no run have background only. Equal boxes must come once. No group holds more than a strip of ``cell``
    rows or columns of one raster, so neither a raster with most runs nor one with most boxes meets in one task.
    """
    boxes_in, runs = boxes, runs.toDF(*runs.columns)  # boxes made from the same runs share their columns
    boxes = boxes.select("raster_id", "y", "x").toDF("raster_id", "y", "x")
    piece = runs.select("raster_id", "row", "class_id", "c0", "c1", F.floor(F.col("row") / cell).alias("br"), F.explode(F.sequence(F.floor(F.col("c0") / cell), F.floor(F.col("c1") / cell))).alias("bc"))
    piece = piece.withColumn("c0", F.greatest("c0", F.col("bc") * cell)).withColumn("c1", F.least("c1", F.col("bc") * cell + cell - 1))
    corners = _corners(boxes, patch, cell)
    met = corners.filter(f"r % {cell} > 0").drop("bc").unionByName(runs.select("raster_id", "row", "class_id", "c0", "c1", F.floor(F.col("row") / cell).alias("br")), allowMissingColumns=True)
    above = grouped(met, ["raster_id", "br"], _rows_above(cell), CORNER)
    left = _fresh(corners.filter(f"c % {cell} > 0 and br > 0")).groupBy("raster_id", "bc").cogroup(_fresh(piece).groupBy("raster_id", "bc")).applyInArrow(_columns_left(cell), CORNER)
    whole = corners.join(_cells(piece, catalog, cell), ["raster_id", "br", "bc"]).select("raster_id", "y", "x", *[(F.col("sign") * F.col(s)).alias(s) for s in PARTS])
    sums = whole.unionByName(above).unionByName(left).groupBy("raster_id", "y", "x").agg(*[F.sum(s).alias(f"px{k}") for k, s in zip(CLASSES, PARTS, strict=True)])
    out = boxes_in.join(sums, ["raster_id", "y", "x"])
    return out.withColumn("px0", F.lit(patch * patch).cast("long") - sum((F.col(f"px{k}") for k in CLASSES), F.lit(0)))
