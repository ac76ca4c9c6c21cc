"""Tiles, grids, centroids, patch catalogs and crops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridrun.functions import geometry as G
from gridrun.functions.draws import draw
from gridrun.operators.runs import run_len


def _col(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def tile_positions(size, patch: int, stride: int) -> Column:
    """Top-left positions covering [0, size); a last one is pushed back to the edge."""
    size = _col(size)
    base = F.sequence(F.lit(0), F.greatest(size - patch, F.lit(0)), F.lit(stride))
    last = F.element_at(base, -1)
    full = F.when(last + patch < size, F.concat(base, F.array(size - patch))).otherwise(base)
    return F.when(size <= patch, F.array(F.lit(0))).otherwise(full).cast("array<int>")


def tiles(catalog: DataFrame, patch: int, overlap: int) -> DataFrame:
    """Tile table ``raster_id, r0, c0, valid_h, valid_w`` with the given overlap."""
    d = catalog.select("raster_id", "height", "width", F.explode(tile_positions(F.col("height"), patch, patch - overlap)).alias("r0"))
    d = d.select("*", F.explode(tile_positions(F.col("width"), patch, patch - overlap)).alias("c0"))
    return d.select("raster_id", "r0", "c0", F.least(F.lit(patch), F.col("height") - F.col("r0")).alias("valid_h"),
                    F.least(F.lit(patch), F.col("width") - F.col("c0")).alias("valid_w"))


def tile_runs(runs: DataFrame, catalog: DataFrame, patch: int, overlap: int) -> DataFrame:
    """Runs cut by (overlapping) tiles; tile numbers are derived per run, no join on tiles.

    A run meets few tile rows and columns, so it is exploded by position and
    the cut is a column expression.
    """
    dims = catalog.select("raster_id", "height", "width")
    d = runs.join(dims, "raster_id")
    hits = lambda size, lo, hi: F.filter(tile_positions(size, patch, patch - overlap), lambda p: (p <= hi) & (p + patch > lo))
    d = d.select("*", F.explode(hits(F.col("height"), F.col("row"), F.col("row"))).alias("tr0")).select(
        "*", F.explode(hits(F.col("width"), F.col("c0"), F.col("c1"))).alias("tc0"))
    return d.withColumn("c0", F.greatest("c0", "tc0")).withColumn("c1", F.least(F.col("c1"), F.col("tc0") + patch - 1)).drop("height", "width")


def validation_grid(catalog: DataFrame, patch: int) -> DataFrame:
    """Non-overlapping cells with the last row and column pushed back to the edge."""
    d = catalog.select("raster_id", "height", "width", F.explode(tile_positions(F.col("height"), patch, patch)).alias("y"))
    return d.select("raster_id", "y", F.explode(tile_positions(F.col("width"), patch, patch)).alias("x"))


def cap_grid(grid: DataFrame, limit: int, seed: int = 42) -> DataFrame:
    """Deterministic sample of at most ``limit`` cells: the smallest seeded hashes."""
    return grid.withColumn("_h", draw(seed, "raster_id", "y", "x")).orderBy("_h", "raster_id", "y", "x").limit(limit).drop("_h")


def clamp_window(center: Column, patch: int, limit: Column) -> Column:
    """``max(0, min(center - patch // 2, limit - patch))``."""
    return F.greatest(F.lit(0), F.least(center - patch // 2, limit - patch)).cast("int")


def force_cells(grid: DataFrame, centroids: DataFrame, catalog: DataFrame, patch: int, classes=(1, 2, 4)) -> DataFrame:
    """Grid plus the cells that hold a centroid of the given classes."""
    snap = lambda v, size: F.least(F.greatest(F.lit(0), F.floor(F.col(v) / patch) * patch), F.greatest(F.lit(0), F.col(size) - patch)).cast("int")
    cells = (centroids.filter(F.col("class_id").isin(*classes)).select("raster_id", "row", "col").distinct()
             .join(catalog.select("raster_id", "height", "width"), "raster_id")
             .select("raster_id", snap("row", "height").alias("y"), snap("col", "width").alias("x")).distinct())
    return grid.unionByName(cells.join(grid, ["raster_id", "y", "x"], "left_anti"))


def feature_centroids(features: DataFrame, catalog: DataFrame) -> DataFrame:
    """Pixel of each feature's area centroid over all its rings, inside the raster only."""
    dims = catalog.select("raster_id", "gt_a", "gt_c", "gt_e", "gt_f", "width", "height")
    d = features.filter(F.size("rings") > 0).withColumn("p", G.rings_centroid(F.col("rings"))).join(dims, "raster_id")
    row = F.floor(F.round((F.col("p.y") - F.col("gt_f")) / F.col("gt_e"), 6)).cast("int")
    col = F.floor(F.round((F.col("p.x") - F.col("gt_c")) / F.col("gt_a"), 6)).cast("int")
    return d.select("raster_id", "feature_id", "class_id", row.alias("row"), col.alias("col"), "width", "height").filter(
        "row >= 0 and row < height and col >= 0 and col < width").drop("width", "height")


def split_parts(multi: DataFrame) -> DataFrame:
    """One row per part of a multi-part feature; parts without area are dropped."""
    rest = [c for c in multi.columns if c != "rings"]
    return multi.select(*rest, F.posexplode("rings").alias("part", "ring")).withColumn("area_m2", G.area(F.col("ring"))).filter(
        "size(ring) >= 4 and area_m2 > 0")


def crop_boxes(features: DataFrame, catalog: DataFrame, pad: float = 0.10, min_side: float = 32) -> DataFrame:
    """Padded box of each feature clipped to its raster; small or empty crops are dropped."""
    dims = catalog.select("raster_id", "gt_a", "gt_c", "gt_e", "gt_f", "width", "height")
    d = features.filter(F.size("rings") > 0).withColumn("b", G.rings_bbox(F.col("rings"))).join(dims, "raster_id")
    d = d.select("raster_id", "feature_id", "class_id",
                 ((F.col("b.x0") - F.col("gt_c")) / F.col("gt_a")).alias("px0"), ((F.col("b.x1") - F.col("gt_c")) / F.col("gt_a")).alias("px1"),
                 ((F.col("b.y1") - F.col("gt_f")) / F.col("gt_e")).alias("py0"), ((F.col("b.y0") - F.col("gt_f")) / F.col("gt_e")).alias("py1"),
                 "width", "height").filter("px1 > px0 and py1 > py0")
    padded = lambda lo, hi, size: (F.greatest(F.col(lo) - pad * (F.col(hi) - F.col(lo)), F.lit(0.0)),
                                   F.least(F.col(hi) + pad * (F.col(hi) - F.col(lo)), F.col(size).cast("double")))
    x0, x1 = padded("px0", "px1", "width")
    y0, y1 = padded("py0", "py1", "height")
    return d.select("raster_id", "feature_id", "class_id", x0.alias("crop_x"), y0.alias("crop_y"), (x1 - x0).alias("crop_w"), (y1 - y0).alias("crop_h")).filter(
        (F.col("crop_w") >= min_side) & (F.col("crop_h") >= min_side))


def _centres(a: Column, b: Column, patch: int, stride: int) -> Column:
    """Middle of a side, and every ``stride`` along one longer than half a patch."""
    mid = F.floor((a + b) / 2).cast("int")
    return F.concat(F.array(mid), F.when(b - a > patch // 2, F.sequence(a, b, F.lit(stride))).otherwise(F.array().cast("array<int>")))


def _sides(boxes: DataFrame, catalog: DataFrame) -> tuple[DataFrame, tuple[Column, ...]]:
    d = boxes.join(catalog.select("raster_id", "height", "width"), "raster_id")
    return d, (F.col("r0"), F.col("r0") + F.col("h"), F.col("c0"), F.col("c0") + F.col("w"))


def patch_positions(boxes: DataFrame, catalog: DataFrame, patch: int, stride: int) -> DataFrame:
    """Patch corners that cover target boxes: box corners, centre, and strided centres of long boxes."""
    d, (top, bot, left, right) = _sides(boxes, catalog)
    cross = F.flatten(F.transform(_centres(top, bot, patch, stride), lambda y: F.transform(_centres(left, right, patch, stride), lambda x: F.struct(y.alias("y"), x.alias("x")))))
    corner = F.array(*[F.struct(y.alias("y"), x.alias("x")) for y in (top, bot) for x in (left, right)])
    d = d.select("raster_id", "height", "width", F.explode(F.concat(corner, cross)).alias("p"))
    return d.select("raster_id", clamp_window(F.col("p.y"), patch, F.col("height")).alias("y"),
                    clamp_window(F.col("p.x"), patch, F.col("width")).alias("x")).distinct()


def patch_places(boxes: DataFrame, catalog: DataFrame, patch: int, stride: int) -> DataFrame:
    """The places of ``patch_positions``, several in a row and some more than once: the corners of ``y0, y1`` by ``x0, x1``, and ``(y2, x2)``.

    A box is one row, but a long one has a row for each pair of its centres.
    """
    d, (top, bot, left, right) = _sides(boxes, catalog)
    at = lambda v, size: clamp_window(v, patch, F.col(size))
    mid = lambda a, b: F.floor((a + b) / 2).cast("int")
    some = d.select("raster_id", *[at(v, "height").alias(f"y{i}") for i, v in enumerate((top, bot, mid(top, bot)))],
                    *[at(v, "width").alias(f"x{i}") for i, v in enumerate((left, right, mid(left, right)))])
    long = d.filter((bot - top > patch // 2) | (right - left > patch // 2))
    long = long.select("raster_id", "height", "width", F.explode(_centres(top, bot, patch, stride)).alias("y"), _centres(left, right, patch, stride).alias("xs"))
    long = long.select("raster_id", at(F.col("y"), "height").alias("y"), F.col("width"), F.explode("xs").alias("x")).select("raster_id", "y", at(F.col("x"), "width").alias("x"))
    return some.unionByName(long.select("raster_id", *[F.col(c).alias(f"{c}{i}") for c in ("y", "x") for i in range(3)]))


def mean_under_boxes(boxes: DataFrame, runs: DataFrame, values, means: dict[str, str], frame: tuple[int, int], cell: int = 32) -> DataFrame:
    """Means over the run pixels under each box ``(raster_id, feature_id, c0, r0, w, h)``; boxes over no run give no row.

    ``values`` makes pixels with the columns of ``means`` from runs. Boxes go row by row and cell by cell to the runs there, so
    a key holds at most ``cell`` runs, and pixels are made only where they are summed: none crosses the shuffle.
    """
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell)))
    cut = lambda lo, hi: (F.greatest(F.col(lo), F.col("cell") * cell).cast("int").alias(lo), F.least(F.col(hi), F.col("cell") * cell + cell - 1).cast("int").alias(hi))
    last = lambda at, size, side: F.least(F.col(at) + F.col(size) - 1, F.lit(side - 1))
    b = boxes.select("raster_id", "feature_id", "r0", last("r0", "h", frame[1]).alias("r1"), F.col("c0").alias("b0"), last("c0", "w", frame[0]).alias("b1")).filter("r0 <= r1 and b0 <= b1")
    b = b.select("raster_id", "feature_id", F.explode(F.sequence("r0", "r1")).alias("row"), "b0", "b1", cells("b0", "b1").alias("cell"))
    b = b.select("raster_id", "feature_id", "row", "cell", *cut("b0", "b1"))
    d = runs.select("raster_id", "class_id", "row", "c0", "c1", cells("c0", "c1").alias("cell")).select("raster_id", "class_id", "row", "cell", *cut("c0", "c1"))
    met = b.join(d, ["raster_id", "row", "cell"]).filter("b0 <= c1 and c0 <= b1").select(
        "raster_id", "feature_id", "row", "class_id", F.greatest("b0", "c0").alias("c0"), F.least("b1", "c1").alias("c1"))
    return values(met).groupBy("raster_id", "feature_id").agg(*[F.avg(v).alias(name) for name, v in means.items()])


def nearest_preview(runs: DataFrame, catalog: DataFrame, max_side: int) -> DataFrame:
    """Nearest-neighbour downsample of a class mask to a long side of ``max_side``.

    Output row i reads source row ``floor(i*H/h)``; runs on other rows vanish
    and column ends map the same way, so it stays in run form.
    """
    d = runs.join(catalog.select("raster_id", "height", "width"), "raster_id")
    scale = F.least(F.lit(1.0), F.lit(float(max_side)) / F.greatest("height", "width"))
    d = d.withColumn("oh", F.greatest(F.lit(1), F.floor(F.col("height") * scale)).cast("int")).withColumn(
        "ow", F.greatest(F.lit(1), F.floor(F.col("width") * scale)).cast("int"))
    first = lambda v, size, out: F.ceil(F.col(v).cast("long") * F.col(out) / F.col(size).cast("double")).cast("int")
    d = d.withColumn("orow", first("row", "height", "oh")).filter("floor(orow * height / double(oh)) = row and orow < oh")
    nxt = F.ceil((F.col("c1") + 1).cast("long") * F.col("ow") / F.col("width").cast("double")).cast("int") - 1
    return d.select("raster_id", F.col("orow").alias("row"), first("c0", "width", "ow").alias("c0"), F.least(nxt, F.col("ow") - 1).alias("c1"), "class_id").filter("c0 <= c1")


def pixel_total(runs: DataFrame):
    return runs.agg(F.sum(run_len()))
