"""Geometric augmentation as coordinate expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridrun.operators.components import _cut
from gridrun.operators.onerow import with_row
from gridrun.operators.ranking import number_rows
from gridrun.operators.runs import class_layer, decode, join_touching, run_len
from gridrun.operators.sampling import uniform
from gridrun.operators.strips import box_layer_of, lay_over


def augment(pixels: DataFrame, width: int, height: int, shift: tuple[int, int] = (0, 0)) -> DataFrame:
    """Horizontal flip, vertical flip, quarter turn and shift of every pixel, tagged by ``kind``."""
    r, c = F.col("row"), F.col("col")
    make = lambda kind, row, col: F.struct(F.lit(kind).alias("kind"), row.cast("int").alias("row"), col.cast("int").alias("col"))
    variants = F.array(make("hflip", r, width - 1 - c), make("vflip", height - 1 - r, c),
                       make("rot90", width - 1 - c, r), make("shift", r + shift[0], c + shift[1]))
    rest = [x for x in pixels.columns if x not in ("row", "col")]
    return pixels.select(*rest, F.explode(variants).alias("v")).select(*rest, "v.*").filter(
        F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1))


def crop_pool(mask: DataFrame, class_id: int, size: int = 64, more_than: int = 50) -> DataFrame:
    """Crops of ``size`` pixels a side with more than ``more_than`` pixels of a class: ``crop, src, top, left, row, c0, c1``.

    Crops are the cells of a fixed lattice over raster ``src``, numbered from 1 over all rasters; the rows are the runs
    of the class in them, in pixels of ``src``. A mask without such a cell gives no rows.
    """
    cell = ["raster_id", "tr", "tc"]
    cut = _cut(class_layer(mask, class_id).select("raster_id", "row", "c0", "c1"), size)
    full = cut.groupBy(*cell).agg(F.sum(run_len()).alias("n")).filter(F.col("n") > more_than).select(*cell)
    return cut.join(number_rows(full, [], cell, "crop"), cell).select(
        "crop", F.col("raster_id").alias("src"), (F.col("tr") * size).alias("top"), (F.col("tc") * size).alias("left"), "row", "c0", "c1")


def draw_crops(pool: DataFrame, catalog: DataFrame, size: int = 64, prob: float = 0.3, seed: int = 42) -> DataFrame:
    """A share of the rasters with the crop they get and where it goes, inside the raster: ``raster_id, crop, y, x``."""
    at = lambda s, side: F.floor(uniform(seed + s, "raster_id") * (F.greatest(F.col(side) - size, F.lit(0)) + 1)).cast("int")
    hit = with_row(catalog.filter(uniform(seed, "raster_id") < prob), pool.agg(F.max("crop").alias("n")))
    return hit.select("raster_id", (F.floor(uniform(seed + 3, "raster_id") * F.col("n")) + 1).alias("crop"), at(1, "height").alias("y"), at(2, "width").alias("x")).filter("crop is not null")


def pasted_runs(pool: DataFrame, draws: DataFrame) -> DataFrame:
    """Runs that the drawn crops put into their rasters, with the way back: ``raster_id, row, c0, c1, src, dr, dc``.

    Pixel ``(row, col)`` comes from ``(row - dr, col - dc)`` of raster ``src``.
    """
    moved = pool.join(draws, "crop").select("raster_id", "src", (F.col("y") - F.col("top")).alias("dr"), (F.col("x") - F.col("left")).alias("dc"), "row", "c0", "c1")
    return moved.select("raster_id", (F.col("row") + F.col("dr")).alias("row"), (F.col("c0") + F.col("dc")).alias("c0"), (F.col("c1") + F.col("dc")).alias("c1"), "src", "dr", "dc")


def paste_mask(mask: DataFrame, pasted: DataFrame, class_id: int) -> DataFrame:
    """The mask with the pasted runs written over it; only target pixels of a crop are pasted."""
    o = lay_over({"m": box_layer_of(mask, "class_id"), "p": box_layer_of(pasted)})
    return join_touching(o.withColumn("class_id", F.when(F.col("p").isNotNull(), class_id).otherwise(F.col("m")).cast("int")).drop("m", "p"))


def paste_bands(image: DataFrame, pasted: DataFrame, bands: list[str], pixels=None, over: DataFrame | None = None) -> DataFrame:
    """``raster_id, row, col`` and the bands after the paste: pasted pixels have the bands of the pixel they come from.

    Pasted pixels that the image doesn't hold yet are added; those whose source pixel it doesn't hold stay as they are.
    With ``pixels`` the first argument holds class runs, and ``pixels(runs)`` makes their pixels with the bands and keeps
    other columns: then stretches are led back to the runs they come from, and no pixel crosses the shuffle. Only
    pixels under the class runs ``over`` are given, with their ``class_id`` there. Pasted runs of a raster don't overlap
    unless they are equal; equal ones give their pixels as often.
    """
    key = ["raster_id", "row", "col"]
    if pixels is not None:
        px = pixels(_origins(image.filter("raster_id is not null"), pasted.filter("raster_id is not null"), over.filter("raster_id is not null")))
        px = px.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), "_n")))
        return px.select(F.col("_to").alias("raster_id"), (F.col("row") + F.col("_dr")).alias("row"), (F.col("col") + F.col("_dc")).alias("col"),
                         F.col("_class").alias("class_id"), *bands)
    source = image.select(F.col("raster_id").alias("src"), F.col("row").alias("_row"), F.col("col").alias("_col"), *bands)
    moved = decode(pasted).select(*key, "src", (F.col("row") - F.col("dr")).alias("_row"), (F.col("col") - F.col("dc")).alias("_col"))
    new = moved.join(source, ["src", "_row", "_col"]).select(*key, *bands)
    return image.select(*key, *bands).join(new.select(*key), key, "left_anti").unionByName(new)


def _origins(mask: DataFrame, pasted: DataFrame, over: DataFrame) -> DataFrame:
    """Runs of ``mask`` that the pixels after the paste come from, with the raster ``_to`` and shift ``_dr, _dc`` they go by, class ``_class`` there and how often, ``_n``."""
    where = [F.col("raster_id").alias("_to"), (F.col("row") - F.col("dr")).alias("row"), (F.col("c0") - F.col("dc")).alias("a"), (F.col("c1") - F.col("dc")).alias("z")]
    moved = pasted.select(*where, F.col("src").alias("raster_id"), "dr", "dc").groupBy("_to", "row", "a", "z", "raster_id", "dr", "dc").agg(F.count("*").alias("n"))
    held = moved.join(mask, ["raster_id", "row"]).filter("c0 <= z and c1 >= a")
    # A stretch's origin as one value: raster, shift, class there, how often.
    new = held.select(F.col("_to").alias("raster_id"), (F.col("row") + F.col("dr")).alias("row"), (F.greatest("c0", "a") + F.col("dc")).alias("c0"),
                      (F.least("c1", "z") + F.col("dc")).alias("c1"), F.concat_ws(",", "raster_id", "dr", "dc", "class_id", "n").alias("origin"))
    o = lay_over({"own": box_layer_of(mask, "class_id"), "origin": box_layer_of(new, "origin"), "over": box_layer_of(over, "class_id")})
    part = F.split("origin", ",")
    at = lambda i, kind, own: F.coalesce(part[i].cast(kind), own.cast(kind))
    none = F.lit(0)
    return o.filter("over is not null and coalesce(cast(own as string), origin) is not null").select(
        at(0, "long", F.col("raster_id")).alias("raster_id"), (F.col("row") - at(1, "int", none)).alias("row"), (F.col("c0") - at(2, "int", none)).alias("c0"),
        (F.col("c1") - at(2, "int", none)).alias("c1"), at(3, "int", F.col("own")).alias("class_id"), F.col("raster_id").alias("_to"),
        at(1, "int", none).alias("_dr"), at(2, "int", none).alias("_dc"), F.col("over").alias("_class"), at(4, "long", F.lit(1)).alias("_n"))
