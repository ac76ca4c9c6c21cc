"""Numbering, top-k and spacing that stay exact when one group holds most rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridrun.operators.strips import grouped, numbers
from gridrun.session import durable, stored


def _order(cols):
    return [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in cols]


def top_k(df: DataFrame, keys: list[str], order: list[str], k: int, salts: int = 16, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key with their rank.

    Two steps: the best ``k`` of each (key, salt) first, so a hot key is split
    over ``salts`` tasks and at most ``k * salts`` of its rows meet in one.
    ``order`` must be a total order; ``-col`` sorts descending.
    """
    salted = df.withColumn("_s", F.pmod(F.xxhash64(*[c.lstrip("-") for c in order]), F.lit(salts)))
    w1 = Window.partitionBy(*keys, "_s").orderBy(*_order(order))
    w2 = Window.partitionBy(*keys).orderBy(*_order(order))
    return (
        salted.withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") <= k).drop("_r", "_s")
        .withColumn(rank, F.row_number().over(w2)).filter(F.col(rank) <= k)
    )


def chunked(df: DataFrame, keys: list[str], order: list[str], chunks: int | None = None) -> DataFrame:
    """Range-partition by (keys, order) and stamp each row with its chunk number and its place in the chunk.

    Range bounds are sampled, so a hot key is spread over many chunks. The rows
    are stored because every later branch must see the same chunks.
    """
    n = chunks or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), 2)
    by = [*[F.col(k) for k in keys], *_order(order)]
    ranged = df.repartitionByRange(n, *by).sortWithinPartitions(*by)
    at = F.monotonically_increasing_id()      # partition and place in it
    return stored(ranged.withColumn("_at", at)).select(*df.columns, F.shiftright("_at", 33).cast("int").alias("_chunk"), (F.col("_at").bitwiseAND((1 << 33) - 1)).alias("_at"))


def number_rows(df: DataFrame, keys: list[str], order: list[str], name: str = "rn", chunks: int | None = None, few: bool = False) -> DataFrame:
    """Exact ``row_number`` per key without putting a key into one task.

    ``order`` must be a total order within the key. With ``few`` keys, as classes, every task gets one row per key and chunk.
    """
    c = chunked(df, keys, order, chunks)
    # One row per (key, chunk): at most keys + chunks rows in total. Rows of a key lie together in a chunk.
    size = c.groupBy(*keys, "_chunk").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    prev = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    off = size.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_chunk").alias("_k_chunk"), (F.coalesce(F.sum("_n").over(prev), F.lit(0)) - F.col("_first") + 1).alias("_off"))
    on = [c[k].eqNullSafe(off[f"_k_{k}"]) for k in keys] + [c["_chunk"] == off["_k_chunk"]]
    joined = c.join(F.broadcast(off) if few or not keys else off, on)      # without keys one row per chunk
    return joined.withColumn(name, (F.col("_at") + F.col("_off")).cast("long")).drop(
        "_at", "_off", "_chunk", "_k_chunk", *[f"_k_{k}" for k in keys])


def running(df: DataFrame, keys: list[str], order: list[str], aggs: dict, chunks: int | None = None,
            keep_chunk: bool = False) -> DataFrame:
    """Running aggregates over rows *before* the current one.

    ``aggs`` maps an output column to ``(fn, column)`` with fn in sum, max, min,
    count. Each chunk is scanned on its own and combined with the aggregate of
    all earlier chunks of its key.
    """
    fn = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}
    c = chunked(df, keys, order, chunks).drop("_at")
    per = c.groupBy(*keys, "_chunk").agg(*[fn[f](col).alias(f"_c_{o}") for o, (f, col) in aggs.items()])
    prev = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    fold = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.sum}
    pre = per.select(*keys, "_chunk", *[fold[f](f"_c_{o}").over(prev).alias(f"_p_{o}") for o, (f, _) in aggs.items()])
    w = Window.partitionBy(*keys, "_chunk").orderBy(*_order(order)).rowsBetween(Window.unboundedPreceding, -1)
    pre = pre.withColumnsRenamed({k: f"_k_{k}" for k in (*keys, "_chunk")})
    on = F.lit(True)
    for k in (*keys, "_chunk"):      # a null key is a key of its own
        on = on & c[k].eqNullSafe(pre[f"_k_{k}"])
    out = c.join(pre if keys else F.broadcast(pre), on).drop(*[f"_k_{k}" for k in (*keys, "_chunk")])
    for o, (f, col) in aggs.items():
        here, before = fn[f](col).over(w), F.col(f"_p_{o}")
        both = {"sum": F.coalesce(before, F.lit(0)) + F.coalesce(here, F.lit(0)),
                "count": F.coalesce(before, F.lit(0)) + F.coalesce(here, F.lit(0)),
                "max": F.greatest(before, here), "min": F.least(before, here)}[f]
        out = out.withColumn(o, both)
    return out.drop(*[f"_p_{o}" for o in aggs], *([] if keep_chunk else ["_chunk"]))


def number_in_frame(df: DataFrame, name: str, first_px: str = "comp_id", block: int = 1 << 16) -> DataFrame:
    """Sequence number per raster in order of the first pixel.

    Counted per block of pixel ids first, so one task sees at most ``block``
    rows of a raster; offsets come from one row per block.
    """
    b = df.withColumn("_b", F.floor(F.col(first_px) / block))
    prev = Window.partitionBy("raster_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    off = b.groupBy("raster_id", "_b").agg(F.count("*").alias("_n")).select(
        "raster_id", "_b", F.coalesce(F.sum("_n").over(prev), F.lit(0)).alias("_off"))
    w = Window.partitionBy("raster_id", "_b").orderBy(first_px)
    return b.join(off, ["raster_id", "_b"]).withColumn(
        name, (F.row_number().over(w) + F.col("_off")).cast("long")).drop("_b", "_off")


def keep_spaced(cands: DataFrame, radius: float, max_items: int, order: list[str], small: int = 5000) -> DataFrame:
    """Greedy suppression per raster, best first, with ``rank`` of the kept.

    A candidate is dropped when a better kept one lies closer than ``radius``
    (strictly); the walk stops at ``max_items``. Rasters with up to ``small``
    candidates are walked in one bounded group each; larger ones go through
    rounds of local maxima, which keep the same candidates (see _spaced_rounds).
    """
    cands = durable(cands)
    sizes = cands.groupBy("raster_id").agg(F.count("*").alias("n"))
    big = sizes.filter(F.col("n") > small).select("raster_id")
    r2 = float(radius) * float(radius)
    cols, schema = cands.columns, cands.schema

    def walk(t: pa.Table, starts: np.ndarray) -> pa.Table:
        t = t.append_column("_g", pa.array(numbers(starts, t.num_rows)))
        t = t.sort_by([("_g", "ascending"), *((c.lstrip("-"), "descending" if c.startswith("-") else "ascending") for c in order)])
        cx, cy = t.column("cx").to_numpy(), t.column("cy").to_numpy()
        kept: list[int] = []
        rank: list[int] = []
        for a, z in zip(starts.tolist(), [*starts[1:].tolist(), t.num_rows], strict=True):
            mine: list[int] = []
            for i in range(a, z):
                if all((cx[i] - cx[j]) ** 2 + (cy[i] - cy[j]) ** 2 >= r2 for j in mine):
                    mine.append(i)
                    if len(mine) >= max_items:
                        break
            kept += mine
            rank += range(1, len(mine) + 1)
        return t.drop_columns("_g").take(pa.array(kept, pa.int64())).append_column("rank", pa.array(rank, pa.int64()))

    out_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", rank long"
    if big.isEmpty():
        return grouped(cands, ["raster_id"], walk, out_schema)
    little = grouped(cands.join(big, "raster_id", "left_anti").select(*cols), ["raster_id"], walk, out_schema)
    return little.unionByName(_spaced_rounds(cands.join(big, "raster_id", "left_semi"), float(radius), max_items, order, cols))


def _spaced_rounds(cands: DataFrame, radius: float, max_items: int, order: list[str], cols: list[str]) -> DataFrame:
    """Greedy suppression without a walk: whoever is better than all in reach is kept, its neighbours go, and so on.

    Cells are so small that two candidates of a cell are always in reach of each other, so only the best of a cell may
    be kept, and it is if it beats the best of every cell around. Nothing is paired within a cell: a round sums up the
    best of each cell, sends it to 24 cells around and removes what lies near a kept one. The best candidate left in a
    raster is always kept, and candidates behind the ``max_items`` best kept ones are dropped, so there are at most
    ``max_items`` rounds, and as a rule about the logarithm of the number of cells.
    """
    side = radius / 2**0.5 * (1 - 1e-9) if radius > 0 else 1.0
    reach = [(i, j) for i in range(-2, 3) for j in range(-2, 3)] if radius > 0 else [(0, 0)]
    cell = ["raster_id", "gx", "gy"]
    key = F.struct(*[(-F.col(c[1:]) if c.startswith("-") else F.col(c)).alias(f"k{i}") for i, c in enumerate(order)])
    alive = cands.select(*cols, key.alias("key"), F.floor(F.col("cx") / side).alias("gx"), F.floor(F.col("cy") / side).alias("gy"))
    if radius <= 0:
        return top_k(cands, ["raster_id"], order, max_items).withColumn("rank", F.col("rank").cast("long"))
    kept = None
    while True:
        best = alive.groupBy(*cell).agg(F.min(F.struct("key", *[c for c in cols if c != "raster_id"])).alias("b"))
        around = F.explode(F.array(*[F.struct((F.col("gx") + i).alias("gx"), (F.col("gy") + j).alias("gy")) for i, j in reach]))
        rival = best.select("raster_id", around.alias("g"), F.col("gx").alias("ox"), F.col("gy").alias("oy"), "b.key").filter("g.gx <> ox or g.gy <> oy")
        rival = rival.groupBy("raster_id", F.col("g.gx").alias("gx"), F.col("g.gy").alias("gy")).agg(F.min("key").alias("rival"))
        chosen = durable(best.join(rival, cell, "left").filter("rival is null or b.key < rival").select("raster_id", "gx", "gy", "b.*"))
        kept = chosen if kept is None else durable(kept.unionByName(chosen))
        last = kept.withColumn("n", F.row_number().over(Window.partitionBy("raster_id").orderBy("key"))).filter(F.col("n") == max_items).select("raster_id", F.col("key").alias("last"))
        near = chosen.select("raster_id", around.alias("g"), F.struct("cx", "cy").alias("p")).groupBy("raster_id", F.col("g.gx").alias("gx"), F.col("g.gy").alias("gy")).agg(F.collect_list("p").alias("near"))  # 25 at most
        hidden = F.exists("near", lambda p: (p["cx"] - F.col("cx")) * (p["cx"] - F.col("cx")) + (p["cy"] - F.col("cy")) * (p["cy"] - F.col("cy")) < radius * radius)
        left = alive.join(near, cell, "left").filter(F.col("near").isNull() | ~hidden).drop("near").join(last, "raster_id", "left").filter("last is null or key < last").drop("last")
        alive = durable(left)
        if alive.isEmpty():
            ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("raster_id").orderBy("key")).cast("long"))
            return ranked.filter(F.col("rank") <= max_items).select(*cols, "rank")
