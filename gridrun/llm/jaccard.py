"""N-gram Jaccard join by MinHash banding.

Equal texts are one class; every class has one signature. Classes meet in the buckets of a shuffle on band hashes;
buckets with the same members (by count and two sums over the members) are kept once. A bucket is split into blocks
of bounded size, and every pair of blocks is verified on the full n-gram sets, by products of incidence matrices, in
a task of its own: out come the number of links of each class and a spanning forest of them, never the pairs. A link
is counted in the least of the buckets that both classes share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridrun.llm.common import SMALL_SLICE, free_name, slices, stored
from gridrun.llm.minhash import band_tables, bands_for, components, shingle_table

THRESHOLD, SHINGLE, ROWS, RECALL = 0.8, 5, 3, 0.9999
BLOCK, BLOCK_CHARS = 800, 8_000_000
#: Groups up to this size are compared together, larger ones by matrix products.
FEW = 8
HELD_CHARS = 3_000_000
SMALL_ROWS = 500_000


def small(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if it has at most SMALL_ROWS rows (of a few numbers each), else as it is."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def band_rows(units: DataFrame, bands: int, rows: int, n: int = SHINGLE) -> DataFrame:
    """``(u, text)`` to ``(u, bh)``: a row per unit and band; units without words have none."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, chars=SMALL_SLICE):
            hashes, has = band_tables(texts, bands, rows, n)
            ids = part.column("u").to_numpy()[has]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, bands)), pa.array(hashes.reshape(-1))], names=["u", "bh"])

    return units.select("u", "text").mapInArrow(scan, "u bigint, bh bigint")


def shared_buckets(rows: DataFrame) -> DataFrame:
    """``(u, bh)`` rows of the buckets with two units or more, each set of members once: ``u, bh, n``."""
    full = rows.groupBy("bh").agg(F.min("u").alias("lo"), F.max("u").alias("hi")).where("lo <> hi").select("bh")
    members = stored(rows.join(small(stored(full)), "bh").distinct())
    stats = members.groupBy("bh").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u")).alias("x"), F.sum(F.shiftright(F.xxhash64("u", F.lit(1)), 24)).alias("y"))
    chosen = stored(stats.groupBy("n", "x", "y").agg(F.min("bh").alias("bh")).select("bh", "n"))
    return members.join(small(chosen), "bh")


def _blocked(members: DataFrame, sizes: DataFrame, block: int) -> DataFrame:
    """Every member of a bucket in all the block pairs it belongs to: ``bh, u, i, j, own``; blocks are bounded in members and characters."""
    chars = members.join(sizes, "u").groupBy("bh").agg(F.sum("chars").alias("chars"))
    count = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("chars") / BLOCK_CHARS), F.lit(1)).cast("int")
    own = members.join(chars, "bh").withColumn("blocks", count).withColumn("own", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("u", "bh"), "blocks")).otherwise(0).cast("int"))
    other = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.select("bh", "u", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")


def _distinct(key: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text in a row, their texts, and where each text begins (one more at the end)."""
    begin = np.searchsorted(owner, np.arange(texts + 1))
    for a, b in zip(begin[:-1], begin[1:], strict=True):
        key[a:b].sort()
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    key, owner = key[new], owner[new]
    return key, owner, np.searchsorted(owner, np.arange(texts + 1))


def few_in_common(key: np.ndarray, owner: np.ndarray, group: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of texts of one group (of ``most`` texts at most) with shingles in common, and how many: ``(a, b, common)``."""
    order = np.lexsort((owner, key, group[owner]))
    key, owner, found = key[order], owner[order], []
    of = group[owner]
    for step in range(1, most):
        same = (key[:-step] == key[step:]) & (of[:-step] == of[step:])
        if not same.any():
            break
        found.append((owner[:-step][same] << 32) | owner[step:][same])
    pairs, common = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
    return pairs >> 32, pairs & 0xFFFFFFFF, common


def many_in_common(key: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sizes of all intersections of the texts of one large group, by products of incidence matrices in pieces of bounded size."""
    m = len(begin) - 1
    owner = np.repeat(np.arange(m), np.diff(begin))
    ids, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    shared = counts > 1
    keep = shared[inverse]
    column, owner = (np.cumsum(shared) - 1)[inverse[keep]], owner[keep]
    out = np.zeros((m, m), dtype=np.float64)
    width = max(256, 4_000_000 // m)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for at in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, [at, at + width])
        piece = np.zeros((m, width), dtype=np.float32)
        piece[owner[a:b], column[a:b] - at] = 1
        out += piece @ piece.T
    return out


def _forest(pairs: list[tuple[int, int]], m: int) -> np.ndarray:
    """Least member that each of ``m`` members is linked with, over any number of links."""
    root = np.arange(m)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return np.array([find(x) for x in range(m)])


def _meet_before(rows: list[tuple]) -> np.ndarray:
    """For the members of one group, which pairs share a lesser bucket too."""
    lesser: dict[int, int] = {}
    places = [(i, lesser.setdefault(h, len(lesser))) for i, r in enumerate(rows) for h in r[5] if h < r[0]]
    out = np.zeros((len(rows), len(rows)), dtype=bool)
    for at in range(0, len(lesser), 2048):
        piece = np.zeros((len(rows), 2048), dtype=np.float32)
        for i, h in places:
            if at <= h < at + 2048:
                piece[i, h - at] = 1
        out |= (piece @ piece.T) > 0
    return out


def _least_linked(near: np.ndarray) -> np.ndarray:
    """Least member that each is linked with over any number of links, from the matrix of links."""
    root = np.full(len(near), -1)
    for start in range(len(near)):
        if root[start] < 0:
            root[start], front = start, np.array([start])
            while len(front):
                front = np.flatnonzero(near[front].any(axis=0) & (root < 0))
                root[front] = start
    return root


def verified(members: DataFrame, texts: DataFrame, threshold: float = THRESHOLD, n: int = SHINGLE, block: int = BLOCK, sizes: DataFrame | None = None) -> DataFrame:
    """Bucket members and the texts of their units to ``u, links, root``: exact links of a unit in one block pair of one bucket.

    ``sizes`` may hold the characters of the units (``u, chars``), so that the texts are read once.
    """
    home = members.groupBy("u").agg(F.sort_array(F.collect_set("bh")).alias("homes"))  # as many as there are bands at most
    if sizes is None:
        sizes = stored(texts.select("u", F.length("text").alias("chars")))
    rows = _blocked(members, sizes, block).join(home, "u").join(texts.select("u", "text"), "u").repartition("bh", "i", "j").sortWithinPartitions("bh", "i", "j", "u")

    def judged(held: list[tuple]) -> pa.RecordBatch:
        """Whole groups: their rows ``(bh, i, j, u, own, homes, text)``, a group's in a row."""
        heads = [x for x in range(len(held)) if not x or held[x][:3] != held[x - 1][:3]]
        sizes = np.diff([*heads, len(held)])
        group = np.repeat(np.arange(len(heads)), sizes)
        own = np.array([r[4] for r in held])
        key, owner, begin = _distinct(*shingle_table([r[6] for r in held], n)[:2], len(held))
        count = np.diff(begin)
        little = sizes[group] <= FEW
        part = little[owner]
        found = [few_in_common(key[part], owner[part], group, FEW)]
        a, b, common = (np.concatenate([f[i] for f in found]) for i in range(3))
        split = np.array([held[h][1] != held[h][2] for h in heads])[group]
        close = (common >= threshold * (count[a] + count[b] - common) - 1e-9) & ~(split[a] & (own[a] == own[b]))  # within its own blocks a pair is verified elsewhere
        pairs = list(zip(a[close].tolist(), b[close].tolist(), strict=True))
        links = np.zeros(len(held), dtype=np.int64)
        for x, y in pairs:
            if next(h for h in held[x][5] if h in held[y][5]) == held[x][0]:
                links[x] += 1
                links[y] += 1
        root = _forest(pairs, len(held))
        at = {x for pair in pairs for x in pair}
        for g in np.flatnonzero(sizes > FEW):
            a, b = heads[g], heads[g] + sizes[g]
            common = many_in_common(key[begin[a] : begin[b]], begin[a : b + 1] - begin[a])
            near = common >= threshold * (count[a:b, None] + count[None, a:b] - common) - 1e-9
            np.fill_diagonal(near, False)
            if split[a]:
                near &= own[a:b, None] != own[None, a:b]
            links[a:b] = (near & ~_meet_before(held[a:b])).sum(axis=1)
            root[a:b] = a + _least_linked(near)
            at |= set((a + np.flatnonzero(near.any(axis=1))).tolist())
        at = sorted(at)
        columns = ([held[x][3] for x in at], links[at].tolist(), [held[root[x]][3] for x in at])
        return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=["u", "links", "root"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0  # characters held
        for part, texts in slices(batches, chars=SMALL_SLICE):
            cols = [part.column(c).to_pylist() for c in ("bh", "i", "j", "u", "own", "homes")]
            for row in zip(*cols, texts, strict=True):
                if size > HELD_CHARS and row[:3] != held[-1][:3]:
                    yield judged(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[6])
        if held:
            yield judged(held)

    return rows.mapInArrow(scan, "u bigint, links bigint, root bigint")


def near_links(units: DataFrame, rows: DataFrame, threshold: float = THRESHOLD, n: int = SHINGLE, sizes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Units ``(u, text)``, repeated or not, and their band rows to ``(u, links)`` and ``(u, label)`` for units with a link.

    ``sizes`` may hold the characters of all units, repeated or not.
    """
    members = stored(shared_buckets(rows))
    wanted = small(members.select("u").distinct())
    texts = units.join(wanted, "u", "left_semi").dropDuplicates(["u"])
    if sizes is not None:
        sizes = stored(sizes.join(wanted, "u", "left_semi").groupBy("u").agg(F.max("chars").alias("chars")))
    found = stored(verified(members, texts, threshold, n, sizes=sizes))
    labels = components(found.where("u <> root").select(F.col("u").alias("a"), F.col("root").alias("b")))
    return found.groupBy("u").agg(F.sum("links").alias("links")), labels.select(F.col("id").alias("u"), "label")


def classes(docs: DataFrame, threshold: float = THRESHOLD, n: int = SHINGLE, rows: int = ROWS, recall: float = RECALL) -> DataFrame:
    """``doc_id, u, class_id, n_links, n_copies``: a row per row of ``docs``.

    Words are runs of non-blank characters as they stand; a text under ``n`` words has one shingle of all its words.
    ``class_id`` is the least doc_id of all texts linked at ``threshold`` or more, over any number of links;
    ``n_links`` counts the other texts linked directly, ``n_copies`` the rows with the very same text (itself
    included). Texts without words, or null, are linked with nothing: their class is their own doc_id. Bands are as
    many as find a pair at the threshold with ``recall``. Rows with a null doc_id take part, and a class of such
    rows alone has a null class_id. No rows in, no rows out.
    """
    keyed = docs.select("doc_id", "text").withColumn("u", F.xxhash64("text"))
    worded = keyed.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    count = bands_for(threshold, recall, rows)
    found = stored(band_rows(worded, count, rows, n))
    links, labels = near_links(worded, found, threshold, n)
    plain = worded.select("doc_id", "u")
    copies = plain.groupBy("u").agg(F.min("doc_id").alias("first"), F.count("*").alias("n_copies"))
    joined = copies.join(labels, "u", "left").join(links, "u", "left").withColumn("label", F.coalesce("label", "u"))
    linked = joined.where(F.col("links").isNotNull())
    least = linked.groupBy("label").agg(F.min("first").alias("least"))
    per_text = joined.join(small(stored(least)), "label", "left").select("u", F.coalesce("least", "first").alias("class_id"), F.coalesce("links", F.lit(0)).alias("n_links"), "n_copies")
    out = plain.join(per_text, "u").select("doc_id", "u", "class_id", "n_links", "n_copies")
    empty = keyed.where(F.col("text").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.unionByName(empty.select("doc_id", "u", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies")))


def keep_one_per_class(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, whose doc_id is the least of its class.

    Rows repeated in full stay once, and so do rows with a null doc_id for each text of theirs; texts without words stay.
    """
    judged = classes(docs, **options)
    kept = judged.where(F.col("doc_id").isNull() | (F.col("doc_id") == F.col("class_id"))).select("doc_id", "u").distinct()
    mark = free_name(docs, "_u")
    marked = docs.withColumn(mark, F.xxhash64("text"))
    out = marked.alias("d").join(kept.alias("k"), F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col(f"d.{mark}") == F.col("k.u")), "left_semi")
    return out.dropDuplicates(["doc_id", mark]).drop(mark)
