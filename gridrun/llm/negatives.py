"""Hard-negative mining over shared candidate lists, one per cluster of anchors.

Anchors are clustered by direction. For each cluster every candidate has one angular upper bound on its inner product
with any member: its norm times the cosine of its angle to the centroid less the cluster's radius. The candidates in
the order of that bound are the list that all members share. The list is laid out once in levels of the bound and
walked from the top, segment by segment: a Spark round deals a segment of the lists still needed into cells of some
members and some candidates, a cell walks its candidates in the order of the bound, and a member leaves the walk once
the bound certifies that nothing further down can enter its result. The last segment ends the list, so the result is
exact. Members and candidates are dealt by hash, so neither a large cluster nor a common vector lands in one cell.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridrun.llm.common import stored

#: Levels of the bound; a list's segments end at levels.
LEVELS = 1024
#: Where the segments of a list end, as parts of all candidates, and the least number of candidates in a segment.
SEGMENTS, LEAST_SEGMENT = (1 / 16, 1 / 4, 1.0), 2048
#: Bounds on the model: clusters, and anchors that the clustering is fitted on.
MOST_CLUSTERS, FIT_ROWS, ANCHORS_PER_CLUSTER = 256, 4096, 64
#: Members and candidates of a cell, and candidates walked at a time.
CELL_MEMBERS, CELL_CANDIDATES, STEP = 512, 1024, 256
#: Rounding of the bounds is allowed for on this scale.
SLACK = 1e-9
EXACT = float(1 << 53)


def quantised(embedding: Column, scale: int = 256) -> Column:
    """Each component x as floor(scale * x); null for a null vector or one with a null or non-finite component."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(embedding, lambda x: F.floor(scale * x.cast("double")).cast("double")))


def coded(values: pa.Array) -> pa.Array:
    """Integer vectors (lists of doubles) as bytes: a letter for the width, then the components in 16, 32 or 64 bits."""
    out = []
    for v in values.to_numpy(zero_copy_only=False):
        v = np.asarray(v, dtype=np.float64)
        top = np.abs(v).max() if len(v) else 0
        kind = "h" if top < 1 << 15 else "i" if top < 1 << 31 else "d"
        out.append(kind.encode() + v.astype(f"<{ {'h': 'i2', 'i': 'i4', 'd': 'f8'}[kind] }").tobytes())
    return pa.array(out, pa.binary())


def decoded(vectors: list[bytes], width: int = 0) -> np.ndarray:
    """Rows of doubles, shorter vectors filled up with zeros."""
    kinds = {ord("h"): "<i2", ord("i"): "<i4", ord("d"): "<f8"}
    if len({(len(v), v[0]) for v in vectors}) == 1:
        out = np.frombuffer(b"".join(v[1:] for v in vectors), dtype=kinds[vectors[0][0]]).reshape(len(vectors), -1).astype(np.float64)
        return out if out.shape[1] >= width else np.pad(out, ((0, 0), (0, width - out.shape[1])))
    rows = [np.frombuffer(v[1:], dtype=kinds[v[0]]) for v in vectors]
    out = np.zeros((len(rows), max([width, *map(len, rows)])))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products, as doubles where they fit and as Python's integers otherwise."""
    if not a.size or not b.size or np.abs(a).max() * np.abs(b).max() * a.shape[1] < EXACT:
        return a @ b.T
    whole = np.frompyfunc(int, 1, 1)
    return whole(a).dot(whole(b).T)


def unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(size > 0, size, 1)


def centroids(sample: np.ndarray, count: int, steps: int = 8) -> np.ndarray:
    """Directions of ``count`` clusters of the sampled anchors; the same for the same sample."""
    rows = unit(sample)
    centre = rows[np.random.default_rng(11).choice(len(rows), min(count, len(rows)), replace=False)]
    for _ in range(steps):
        own = (rows @ centre.T).argmax(axis=1)
        sums = np.zeros_like(centre)
        np.add.at(sums, own, rows)
        centre = np.where(np.abs(sums).sum(axis=1, keepdims=True) > 0, unit(sums), centre)
    return centre


def angles(rows: np.ndarray, centre: np.ndarray) -> np.ndarray:
    width = max(rows.shape[1], centre.shape[1])
    pad = lambda x: np.pad(x, ((0, 0), (0, width - x.shape[1])))
    return np.arccos(np.clip(unit(pad(rows)) @ pad(centre).T, -1, 1))


def prepared(rows: DataFrame) -> DataFrame:
    """``vec_id, label, vec, norm``: quantised vectors as bytes; of rows with one vec_id the least by label and bytes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), coded(b.column("q"))], names=["vec_id", "label", "vec"])

    kept = rows.where("vec_id is not null and label is not null and q is not null").select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "q")
    one = kept.mapInArrow(scan, "vec_id long, label long, vec binary").groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("r")).select("vec_id", "r.label", "r.vec")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                norm = np.linalg.norm(decoded(b.column("vec").to_pylist()), axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(norm)], names=[*b.schema.names, "norm"])

    return stored(one.mapInArrow(measure, "vec_id long, label long, vec binary, norm double"))


class Lists:
    """The shared lists: centroids, radii, and for each cluster the segment of every level of the bound. Tasks get it whole, so it holds no tables."""

    def __init__(self, centre: np.ndarray, radius: np.ndarray, top: float):
        self.centre, self.radius, self.top = centre, radius, top

    def bounds(self, vectors: list[bytes], norm: np.ndarray) -> np.ndarray:
        """Upper bounds of rows x clusters; a member's own norm is still to be multiplied in."""
        return norm[:, None] * np.cos(np.maximum(0, angles(decoded(vectors), self.centre) - self.radius))

    def level(self, bound: np.ndarray) -> np.ndarray:
        return np.clip(((bound / self.top + 1) / 2 * LEVELS).astype(np.int64), 0, LEVELS - 1)

    def edge(self, level: int) -> float:
        """No bound of a level under ``level`` is above this."""
        return (2 * level / LEVELS - 1) * self.top + SLACK * self.top

    def lay_out(self, sums: dict[int, int]) -> None:
        """Segments from the number of candidates of every cluster and level."""
        counts = np.zeros((len(self.centre), LEVELS), dtype=np.int64)
        for key, n in sums.items():
            counts[key // LEVELS, key % LEVELS] = n
        down = counts[:, ::-1].cumsum(axis=1)
        total = down[:, -1:]
        ends = np.maximum(np.array(SEGMENTS) * total, LEAST_SEGMENT * np.arange(1, len(SEGMENTS) + 1))
        ends[:, -1] = np.inf
        segment = (np.concatenate([np.zeros_like(total), down[:, :-1]], axis=1)[:, :, None] >= ends[:, None, :]).sum(axis=2)
        self.segment = segment[:, ::-1].astype(np.int8)
        self.sizes = np.array([[counts[g][self.segment[g] == s].sum() for s in range(len(SEGMENTS))] for g in range(len(counts))])
        #: What no candidate after the segment exceeds.
        self.rest = np.array([[self.edge(int((self.segment[g] > s).sum())) if s + 1 < len(SEGMENTS) and self.sizes[g, s + 1 :].sum() else -np.inf for s in range(len(SEGMENTS))] for g in range(len(counts))])


def clustered(vectors: DataFrame, anchors: DataFrame) -> tuple[Lists, DataFrame]:
    """The lists of all clusters, and the anchors with their cluster ``g`` and angle to its centroid.

    To the driver come at most about FIT_ROWS sampled anchors, a radius per cluster, and MOST_CLUSTERS x LEVELS counts.
    """
    size = anchors.agg(F.count("*").alias("n")).first().n
    count = min(MOST_CLUSTERS, max(1, size // ANCHORS_PER_CLUSTER))
    drawn = anchors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) / float(1 << 30) < FIT_ROWS / size).select("vec_id", "vec").collect()
    drawn = drawn or anchors.orderBy("vec_id").limit(1).select("vec_id", "vec").collect()
    centre = centroids(decoded([r.vec for r in sorted(drawn, key=lambda r: r.vec_id)]), count)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                angle = angles(decoded(b.column("vec").to_pylist()), centre)
                near = angle.argmin(axis=1)
                at = np.where(np.asarray(b.column("norm")) > 0, angle[np.arange(len(near)), near], 0)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32)), pa.array(at)], names=[*b.schema.names, "g", "angle"])

    assigned = stored(anchors.mapInArrow(assign, "vec_id long, label long, vec binary, norm double, g int, angle double"))
    radius = np.zeros(len(centre))
    for r in assigned.groupBy("g").agg(F.max("angle").alias("a")).collect():
        radius[r.g] = r.a
    lists = Lists(centre, radius, vectors.agg(F.max("norm").alias("m")).first().m or 1.0)

    def count_levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                level = lists.level(lists.bounds(b.column("vec").to_pylist(), np.asarray(b.column("norm"))))
                key, n = np.unique(level + LEVELS * np.arange(level.shape[1]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])

    sums = vectors.mapInArrow(count_levels, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    lists.lay_out({r.key: r.n for r in sums.collect()})
    return lists, assigned


def walk(lists: Lists, vectors: DataFrame, members: DataFrame, s: int, cell, schema: str) -> DataFrame:
    """Segment ``s`` of the lists, walked by ``members`` (with g, and a least ``need`` each) cell by cell."""
    here = {r.g: r.n for r in members.groupBy("g").agg(F.count("*").alias("n")).collect()}
    blocks = {g: (-(-n // CELL_MEMBERS), -(-int(lists.sizes[g, s]) // CELL_CANDIDATES)) for g, n in here.items()}
    blocks = {g: b for g, b in blocks.items() if b[1]}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            bound = lists.bounds(b.column("vec").to_pylist(), np.asarray(b.column("norm")))
            at = lists.segment[np.arange(bound.shape[1]), lists.level(bound)] == s
            spread = np.asarray(b.column("spread"))
            for g, (m, c) in blocks.items():
                rows = np.flatnonzero(at[:, g])
                if len(rows):
                    part = b.take(pa.array(rows))
                    for i in range(m):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), g, np.int32)), pa.array(np.full(len(rows), i, np.int32)), pa.array((spread[rows] % c).astype(np.int32)), part.column("vec_id"), part.column("label"), part.column("vec"), pa.array(bound[rows, g])], names=["g", "mb", "cb", "vec_id", "label", "vec", "bound"])

    candidates = vectors.withColumn("spread", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(1 << 30))).mapInArrow(deal, "g int, mb int, cb int, vec_id long, label long, vec binary, bound double")
    of = lambda k: F.element_at(F.array(*[F.lit(blocks.get(g, (0, 0))[k]) for g in range(len(lists.centre))]), F.col("g") + 1)
    dealt = members.where(of(1) > 0).withColumn("mb", F.pmod(F.xxhash64("vec_id", F.lit(2)), of(0).cast("long")).cast("int")).withColumn("cb", F.explode(F.sequence(F.lit(0), of(1) - 1)))
    keys = ["g", "mb", "cb"]
    return dealt.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(cell, schema)


def best_of(member: np.ndarray, score: np.ndarray, other: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of each member: highest score first, ties by the smaller id."""
    order = np.lexsort((other, -score, member))
    m = member[order]
    start = np.flatnonzero(np.r_[True, m[1:] != m[:-1]]) if len(m) else np.zeros(0, int)
    place = np.arange(len(m)) - np.repeat(start, np.diff(np.r_[start, len(m)]))
    return order[place < k]


def searched(members: pa.Table, candidates: pa.Table, lo: np.ndarray, hi: np.ndarray, need: np.ndarray, same: bool, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Walk of one cell: ``(member, goal, candidate's id, score)`` of the first ``k`` for every member and goal.

    A goal is a range of scores, ``lo`` to ``hi`` (members x goals); a score under ``need`` can't enter its result any
    more. Candidates come by falling bound, and a member leaves once the bound is under all that it needs.
    """
    a, x = decoded(members.column("vec").to_pylist()), decoded(candidates.column("vec").to_pylist())
    width = max(a.shape[1], x.shape[1])
    a, x = (np.pad(v, ((0, 0), (0, width - v.shape[1]))) for v in (a, x))
    bound = candidates.column("bound").to_numpy()
    order = np.argsort(-bound, kind="stable")
    x, bound = x[order], bound[order]
    ids, labels = candidates.column("vec_id").to_numpy()[order], candidates.column("label").to_numpy()[order]
    own, label, norm = members.column("vec_id").to_numpy(), members.column("label").to_numpy(), members.column("norm").to_numpy()
    need = np.maximum(need, lo)
    goals = need.shape[1]
    found = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]
    for at in range(0, len(x), STEP):
        most = norm * bound[at] + SLACK * (1 + np.abs(norm * bound[at]))
        live = np.flatnonzero(most >= np.where(hi >= lo, need, np.inf).min(axis=1))
        if not len(live):
            break
        part = slice(at, at + STEP)
        score = products(a[live], x[part])
        fits = (labels[part] == label[live, None]) == same
        fits &= ids[part] != own[live, None]
        for goal in range(goals):
            i, j = np.nonzero(fits & (score >= need[live, goal, None]) & (score <= hi[live, goal, None]))
            for n, new in enumerate((live[i] * goals + goal, score[i, j], ids[part][j])):
                found[n] = np.concatenate([found[n], new])
        keep = best_of(*found, k)
        found = [f[keep] for f in found]
        if len(found[0]):
            slot, n = np.unique(found[0], return_counts=True)
            full = np.cumsum(n) - 1
            full, slot = full[n == k], slot[n == k]
            need.reshape(-1)[slot] = np.maximum(need.reshape(-1)[slot], found[1][full].astype(np.float64))
    return found[0] // goals, found[0] % goals, found[2], found[1]


def positive_cell(k: int):
    def cell(key: tuple, members: pa.Table, candidates: pa.Table) -> pa.Table:
        need = members.column("need").to_numpy()[:, None].copy()
        if not members.num_rows or not candidates.num_rows:
            return pa.table({"anchor_id": pa.array([], pa.int64()), "other_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        open_ = np.full_like(need, -np.inf), np.full_like(need, np.inf)
        m, _, other, score = searched(members, candidates, *open_, need, True, k)
        return pa.table({"anchor_id": members.column("vec_id").to_numpy()[m], "other_id": other, "score": pa.array([int(s) for s in score], pa.int64())})

    return cell


def negative_cell(k: int, goals: int):
    def cell(key: tuple, members: pa.Table, candidates: pa.Table) -> pa.Table:
        if not members.num_rows or not candidates.num_rows:
            return pa.table({"anchor_id": pa.array([], pa.int64()), "goal": pa.array([], pa.int32()), "other_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        lo, hi, need = (np.array([row + [v] * (goals - len(row)) for row in members.column(c).to_pylist()], dtype=np.float64) for c, v in (("lo", 0.0), ("hi", -1.0), ("needs", np.inf)))
        m, goal, other, score = searched(members, candidates, lo, hi, need, False, k)
        return pa.table({"anchor_id": members.column("vec_id").to_numpy()[m], "goal": goal.astype(np.int32), "other_id": other, "score": pa.array([int(s) for s in score], pa.int64())})

    return cell


def first_k(rows: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """First ``k`` rows of each key with their ``rank``; a task sends on ``k`` rows of a key at most."""
    by = Window.partitionBy(*keys).orderBy(F.desc("score"), "other_id")
    return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: tuple[int, int] = (50, 100), high: tuple[int, int] = (95, 100)) -> DataFrame:
    """For each anchor and each of its positives the first hard negatives.

    ``vectors`` has vec_id, label and q (a list of integers as doubles). A score is the integer inner product with the
    anchor. Positives are the first ``positives`` other rows of the anchor's label; negatives of a positive are the
    first ``negatives`` rows of other labels whose score is at least low[0] / low[1] and at most high[0] / high[1] of
    the positive's. Scores come highest first, ties by smaller vec_id. Returns anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score.

    Rows with a null vec_id, label or q take no part. Of rows with one vec_id the least by label and coded vector
    counts. Vectors of different lengths meet on their common part. An anchor without another row of its label, or
    without a row in the range, has no rows; so has an empty table. Scores must fit 64 bits.
    """
    spark = vectors.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    known = prepared(vectors)
    anchors = known.where(is_anchor)
    if anchors.isEmpty():
        return spark.createDataFrame([], schema)
    lists, anchors = clustered(known, anchors)
    best = positives_walked(lists, known, anchors, positives)
    goals = best.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("p"))
    found = negatives_walked(lists, known, anchors, goals, negatives, positives, low, high)
    pairs = best.select("anchor_id", (F.col("rank") - 1).alias("goal"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(pairs, ["anchor_id", "goal"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def after(lists: Lists, s: int) -> Column:
    """What a member's score with any candidate after segment ``s`` doesn't exceed."""
    rest = F.element_at(F.array(*[F.lit(float(r)) for r in lists.rest[:, s]]), F.col("g") + 1)
    return F.when(rest == float("-inf"), rest).otherwise(F.col("norm") * rest + SLACK * (1 + F.abs(F.col("norm") * rest)))


def positives_walked(lists: Lists, known: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """``anchor_id, other_id, score, rank``: the first ``k`` other rows of each member's label."""
    members, best = anchors.withColumn("need", F.lit(float("-inf"))), None
    for s in range(len(SEGMENTS)):
        new = walk(lists, known, members, s, positive_cell(k), "anchor_id long, other_id long, score long")
        best = stored(first_k(new if best is None else new.unionByName(best.drop("rank")), ["anchor_id"], k))
        if s + 1 == len(SEGMENTS):
            break
        kth = best.where(F.col("rank") == k).select(F.col("anchor_id").alias("vec_id"), F.col("score").cast("double").alias("kth"))
        members = stored(anchors.join(kth, "vec_id", "left").withColumn("need", F.coalesce("kth", F.lit(float("-inf")))).drop("kth").where(F.col("need") <= after(lists, s)))
        if members.isEmpty():
            break
    return best


def negatives_walked(lists: Lists, known: DataFrame, anchors: DataFrame, goals: DataFrame, k: int, most: int, low: tuple[int, int], high: tuple[int, int]) -> DataFrame:
    """``anchor_id, goal, other_id, score, rank``: the first ``k`` rows of other labels in the range of each positive."""
    whole = lambda p: p["score"].cast("decimal(38,0)")
    lo = F.transform("p", lambda p: F.ceil(whole(p) * low[0] / low[1]).cast("double"))
    hi = F.transform("p", lambda p: F.floor(whole(p) * high[0] / high[1]).cast("double"))
    ranges = goals.select(F.col("anchor_id").alias("vec_id"), lo.alias("lo"), hi.alias("hi"))
    start = stored(anchors.join(ranges, "vec_id"))
    members, found = start.withColumn("needs", F.col("lo")), None
    for s in range(len(SEGMENTS)):
        new = walk(lists, known, members, s, negative_cell(k, most), "anchor_id long, goal int, other_id long, score long")
        found = stored(first_k(new if found is None else new.unionByName(found.drop("rank")), ["anchor_id", "goal"], k))
        if s + 1 == len(SEGMENTS):
            break
        kth = found.where(F.col("rank") == k).groupBy(F.col("anchor_id").alias("vec_id")).agg(F.map_from_entries(F.collect_list(F.struct("goal", F.col("score").cast("double")))).alias("kth"))
        needs = F.transform("lo", lambda x, i: F.greatest(x, F.coalesce(F.element_at("kth", i), F.lit(float("-inf")))))
        rest = after(lists, s)
        open_ = F.exists(F.arrays_zip("needs", "lo", "hi"), lambda r: (r["lo"] <= r["hi"]) & (r["needs"] <= rest))
        members = stored(start.join(kth, "vec_id", "left").withColumn("needs", needs).drop("kth").where(open_))
        if members.isEmpty():
            break
    return found


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """``mine`` over ``embeddings`` as its query has it: components floor(256 * x), every 50th vec_id an anchor, labels of every 7th moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = embeddings.select(F.col("vec_id").alias("vec_id"), label.alias("label"), quantised(F.col("embedding")).alias("q"))
    return mine(rows, F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
