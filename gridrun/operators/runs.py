"""Row-run algebra.

A *run* is ``(raster_id, row, c0, c1)`` with inclusive ends, plus optional value
columns. Runs of one layer never overlap inside a row. Every operator here
groups by ``(raster_id, row)``: such a group is bounded by the raster width, so
a raster that holds most of the data is still spread over all of its rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridrun.operators.strips import box_layer_of, lay_over

ROW = ("raster_id", "row")


def _constant_runs(df: DataFrame, keys, values) -> DataFrame:
    """Breakpoints ``(keys, pos, values)`` -> maximal runs of constant values.

    A breakpoint's values hold until the next one; stretches whose values are
    all null are dropped.
    """
    w = Window.partitionBy(*keys).orderBy("pos")
    state = F.struct(*values)
    present = reduce(lambda a, b: a | b, [F.col(v).isNotNull() for v in values])
    return (
        df.withColumn("_prev", F.lag(state).over(w))
        .filter(~F.col("_prev").eqNullSafe(state))
        .withColumn("c1", F.lead("pos").over(w) - 1)
        .filter(F.col("c1").isNotNull() & present)
        .select(*keys, F.col("pos").alias("c0"), F.col("c1").cast("int").alias("c1"), *values)
    )


def _edges(df: DataFrame, keys, extra=()) -> DataFrame:
    """Each run -> a +1 event at its start and a -1 event behind its end."""
    ev = F.explode(F.array(
        F.struct(F.col("c0").cast("int").alias("pos"), F.lit(1).alias("d")),
        F.struct((F.col("c1") + 1).cast("int").alias("pos"), F.lit(-1).alias("d")),
    ))
    return df.select(*keys, *extra, ev.alias("e")).select(*keys, *extra, "e.pos", "e.d")


def coverage(df: DataFrame, keys=ROW, need: int | Column = 1, preaggregate: bool = False) -> DataFrame:
    """Maximal runs covered by at least ``need`` input runs.

    ``need=1`` is the union of layers, ``need=n`` the intersection of n layers.
    ``preaggregate`` combines equal breakpoints before the shuffle; use it when
    many input runs may pile up on few rows.
    """
    keys = list(keys)
    ev = _edges(df, keys)
    if not preaggregate:
        ev = ev.repartition(*keys)
    agg = ev.groupBy(*keys, "pos").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(*keys).orderBy("pos")
    need = F.lit(need) if isinstance(need, int) else need
    steps = agg.withColumn("_n", F.sum("d").over(w)).withColumn("hit", F.when(F.col("_n") >= need, 1))
    return _constant_runs(steps.select(*keys, "pos", "hit"), keys, ["hit"]).drop("hit")


def merge_runs(df: DataFrame, keys=ROW) -> DataFrame:
    """Union of possibly overlapping or touching runs as maximal runs."""
    return coverage(df, keys, 1)


def encode(pixels: DataFrame, keys=("raster_id", "class_id", "row")) -> DataFrame:
    """Pixels ``(keys, col)`` -> maximal runs, by ``col - row_number``."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("col")
    return (
        pixels.withColumn("_g", F.col("col") - F.row_number().over(w))
        .groupBy(*keys, "_g")
        .agg(F.min("col").cast("int").alias("c0"), F.max("col").cast("int").alias("c1"))
        .drop("_g")
    )


def decode(runs: DataFrame) -> DataFrame:
    """Runs -> one row per pixel, other columns kept."""
    rest = [c for c in runs.columns if c not in ("c0", "c1")]
    return runs.select(*rest, F.explode(F.sequence("c0", "c1")).alias("col"))


def overlay(layers: dict[str, DataFrame], keys=ROW, dense: tuple[str, ...] = ()) -> DataFrame:
    """Split rows into segments on which every layer is constant.

    ``layers`` maps an output column to runs ``(keys, c0, c1, value)``. A layer
    without a run on a segment gives null there. One shuffle for any number of
    layers; no pair of runs is ever joined.

    ``dense`` names layers that tile every row without gaps: their ends need
    not be sent. Then only segments under some other layer are reported whole.
    """
    keys, names = list(keys), list(layers)
    parts = []
    for name, df in layers.items():
        if name in dense:
            parts.append(df.select(*keys, F.col("c0").cast("int").alias("pos"), F.col("value").alias(f"v_{name}"), F.lit(1).alias(f"s_{name}")))
            continue
        ev = F.explode(F.array(
            F.struct(F.col("c0").cast("int").alias("pos"), F.col("value").alias("v")),
            F.struct((F.col("c1") + 1).cast("int").alias("pos"), F.lit(None).alias("v")),
        ))
        part = df.select(*keys, ev.alias("e")).select(
            *keys, "e.pos",
            F.col("e.v").alias(f"v_{name}"), F.lit(1).alias(f"s_{name}"))
        parts.append(part)
    events = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).repartition(*keys)
    # At one position an ending and a starting run meet: max() keeps the start.
    agg = events.groupBy(*keys, "pos").agg(
        *[F.max(f"v_{n}").alias(f"v_{n}") for n in names],
        *[F.max(f"s_{n}").alias(f"s_{n}") for n in names])
    w = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    steps = agg.select(*keys, "pos", *[
        F.last(F.when(F.col(f"s_{n}") == 1, F.struct(F.col(f"v_{n}").alias("v"))), ignorenulls=True)
        .over(w).getField("v").alias(n) for n in names])
    return _constant_runs(steps, keys, names)


def as_layer(runs: DataFrame, value: Column | str | None = None) -> DataFrame:
    """Runs -> an ``overlay`` input; without ``value`` a mere presence layer."""
    if value is None:
        value = F.lit(1)
    value = F.col(value) if isinstance(value, str) else value
    return runs.select("raster_id", "row", "c0", "c1", value.alias("value"))


def run_len() -> Column:
    return (F.col("c1") - F.col("c0") + 1).cast("long")


def frame_rows(catalog: DataFrame) -> DataFrame:
    """One full-width run per raster row."""
    return catalog.select(
        "raster_id", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("row"),
        F.lit(0).alias("c0"), (F.col("width") - 1).alias("c1"))


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pixels in both layers."""
    return (overlay({"a": as_layer(a), "b": as_layer(b)})
            .filter("a is not null and b is not null").drop("a", "b"))


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pixels of ``a`` that are not in ``b``."""
    return (overlay({"a": as_layer(a), "b": as_layer(b)})
            .filter("a is not null and b is null").drop("a", "b"))


def subtract_boxes(a: DataFrame, b: DataFrame) -> DataFrame:
    """``subtract`` of burned boxes ``(raster_id, r0, r1, c0, c1)``; both are burned and laid over each other in one pass."""
    return lay_over({"a": box_layer_of(a), "b": box_layer_of(b)}, ("a", "b"), under="a").filter("b is null").drop("a", "b")


def window_clip(runs: DataFrame, r0: int, c0: int, h: int, w: int) -> DataFrame:
    """Runs inside a pixel window; the row test reaches the scan."""
    return (
        runs.filter((F.col("row") >= r0) & (F.col("row") < r0 + h) & (F.col("c0") < c0 + w) & (F.col("c1") >= c0))
        .withColumn("c0", F.greatest(F.col("c0"), F.lit(c0)))
        .withColumn("c1", F.least(F.col("c1"), F.lit(c0 + w - 1)))
    )


def class_layer(mask: DataFrame, class_id: int) -> DataFrame:
    """Runs of one class of a class mask."""
    return mask.filter(F.col("class_id") == class_id).drop("class_id")


def repaint(mask: DataFrame, old_class: int, new_runs: DataFrame, background_only: bool = False) -> DataFrame:
    """Clear ``old_class`` and write ``new_runs`` as that class.

    Written pixels win over any other class, or only over background when
    ``background_only`` (then the old pixels are kept as well).
    """
    o = lay_over({"m": box_layer_of(mask, "class_id"), "n": box_layer_of(new_runs)})
    if background_only:
        cls = F.coalesce(F.col("m"), F.when(F.col("n").isNotNull(), old_class))
    else:
        cls = F.when(F.col("n").isNotNull(), old_class).otherwise(
            F.when(F.col("m") != old_class, F.col("m")))
    return join_touching(o.withColumn("class_id", cls.cast("int")).filter("class_id is not null").drop("m", "n"))


def join_touching(mask: DataFrame) -> DataFrame:
    """Merge neighbouring segments of equal class (no overlaps in the input)."""
    return lay_over({"class_id": box_layer_of(mask, "class_id")})
