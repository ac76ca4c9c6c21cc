"""Mixing sources to target weights by capped water-filling; DataFrame functions only.

Every source gets a share of all words by weight, but never more than ``max_epochs`` times its own words; what a
capped source can't take goes to the others by weight. The final level is found in one pass: sources in order of
cap over weight are capped as long as their cap lies under the level that the sources from there on would share.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridrun.llm.common import stored, word_count

#: Cells by hash into which the documents of a source are dealt, so that no window holds a whole source.
CELLS = 1024
#: Up to so many sources, of a few numbers each, are sent to every task.
MOST_SOURCES = 100_000


def draw_order(doc_id: Column, seed: str) -> Column:
    """A 60-bit draw number of a document: the same in every run and at every partitioning."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), max_epochs: int = 3, share: float = 1.0) -> DataFrame:
    """``(source, source_size)`` rows to ``(source, source_size, target)``.

    Sources by code point, null last, take the weights in turn. The windows below run over one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "pick")
    everything = Window.partitionBy()
    wheel = F.array(*[F.lit(float(w)) for w in weights])
    rows = (
        sizes.withColumn("pick", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(wheel, ((F.col("pick") - 1) % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("at", F.row_number().over(by_ratio))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("sharing", F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("stop", F.min(F.when(F.col("ratio") > F.col("left") / F.col("sharing"), F.col("at"))).over(everything))
        .withColumn("level_left", F.max(F.when(F.col("at") == F.col("stop"), F.col("left"))).over(everything))
        .withColumn("level_sharing", F.max(F.when(F.col("at") == F.col("stop"), F.col("sharing"))).over(everything))
    )
    capped = F.col("stop").isNull() | (F.col("at") < F.col("stop"))
    target = F.when(capped, F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("level_left") / F.col("level_sharing"))
    return rows.select("source", "source_size", target.alias("target"))


def source_cuts(sized: DataFrame, weights: Sequence[float], max_epochs: int) -> DataFrame:
    """One row per source: ``source, source_size, target, whole`` (times that it is repeated as a whole) and the cut.

    The rest of the target is taken from the source's documents in seeded order. ``cut`` is the key of the document in
    which the rest ends and ``cut_taken`` the words taken of it; it is looked for in the one cell that holds it.
    """
    cells = stored(sized.groupBy("source", "_cell").agg(F.sum("size").alias("_cell_size")))
    targets = source_targets(cells.groupBy("source").agg(F.sum("_cell_size").alias("source_size")), weights, max_epochs)
    targets = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(0).cast("long"))
    targets = targets.withColumn("_rest", F.floor("target").cast("long") - F.col("whole") * F.col("source_size"))
    earlier = Window.partitionBy("source").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.withColumn("_start", F.coalesce(F.sum("_cell_size").over(earlier), F.lit(0))).withColumnRenamed("source", "_s")
    at = starts.join(targets, F.col("_s").eqNullSafe(F.col("source"))).where((F.col("_start") <= F.col("_rest")) & (F.col("_rest") < F.col("_start") + F.col("_cell_size")))
    at = stored(at.select(F.col("source").alias("_s"), F.col("_cell").alias("_at"), (F.col("_rest") - F.col("_start")).alias("_left")))
    inside = sized.join(at, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_cell") == F.col("_at")))
    keys = inside.groupBy("_s", "key").agg(F.sum("size").alias("_sum"), F.count("*").alias("_n"), F.first("_left").alias("_left"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy("_s").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = keys.withColumn("_before", before).where((F.col("_before") <= F.col("_left")) & (F.col("_left") < F.col("_before") + F.col("_sum")))
    cuts = cuts.select("_s", F.col("key").alias("cut"), F.floor((F.col("_left") - F.col("_before")) / F.col("_n")).alias("cut_taken"))
    return stored(targets.join(cuts, F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "source_size", "target", "whole", "cut", "cut_taken"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_epochs: int = 3, seed: str = "mix", carry: Sequence[str] = ()) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (and the ``carry`` columns of ``docs``).

    A source is repeated whole ``target div source_size`` times; the rest of its target is taken from its documents
    in seeded order (draw, doc_id, size, text), the last one only as far as the target needs. So the words taken are
    the target's whole part. Documents themselves are neither shuffled nor sorted: each is held against its source's
    row, in which the rest ends.

    Documents without words, with null text or of an empty source take 0. A null source is a source of its own.
    Repeated rows are documents of their own; if the rest ends in equal rows, they share what is left evenly, down to
    whole words. Texts of any length count whole. ``docs`` may have columns of the result's or of other names; only
    those in ``carry`` come along. No rows in, no rows out.
    """
    draw = draw_order(F.col("doc_id"), seed)
    key = F.struct(draw.alias("draw"), F.col("doc_id").alias("doc_id"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text"))
    rows = docs.select(F.col("source").alias("source"), key.alias("key"), *[F.col(c).alias(f"_c_{c}") for c in carry]).withColumn("size", F.col("key.size"))
    sized = rows.select("source", "key", "size", F.shiftright("key.draw", 60 - CELLS.bit_length() + 1).alias("_cell"))
    cuts = source_cuts(sized, weights, max_epochs).withColumnRenamed("source", "_source")
    joined = rows.join(F.broadcast(cuts) if cuts.limit(MOST_SOURCES + 1).count() <= MOST_SOURCES else cuts, F.col("source").eqNullSafe(F.col("_source")))
    part = F.when(F.col("key") < F.col("cut"), F.col("size")).when(F.col("key") == F.col("cut"), F.col("cut_taken")).otherwise(0)
    taken = F.col("whole") * F.col("size") + F.coalesce(part, F.lit(0))
    return joined.select(F.col("key.doc_id").alias("doc_id"), "size", "source_size", "target", taken.cast("long").alias("taken"), *[F.col(f"_c_{c}").alias(c) for c in carry if c != "doc_id"])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS draw
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS pick FROM s),
c AS (SELECT *, CASE (pick - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 3 * source_size AS cap FROM w),
r AS (SELECT *, cap / weight AS ratio, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM c),
o AS (SELECT *, row_number() OVER (ORDER BY ratio, pick) AS rank,
        total - coalesce(sum(cap) OVER (ORDER BY ratio, pick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
        sum(weight) OVER (ORDER BY ratio, pick ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS sharing FROM r),
f AS (SELECT min(rank) AS stop FROM o WHERE ratio > rest / sharing),
t AS (SELECT o.source, o.source_size,
        CASE WHEN f.stop IS NULL OR o.rank < f.stop THEN CAST(o.cap AS DOUBLE)
             ELSE o.weight * (SELECT rest FROM o, f WHERE rank = stop) / (SELECT sharing FROM o, f WHERE rank = stop) END AS target
      FROM o, f),
p AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d),
j AS (SELECT p.*, t.source_size, t.target,
        CASE WHEN t.source_size > 0 THEN CAST(floor(floor(t.target) / t.source_size) AS BIGINT) ELSE 0 END AS whole
      FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + greatest(0, least(size, floor(target) - whole * source_size - before)) AS BIGINT) AS taken
FROM j
"""
