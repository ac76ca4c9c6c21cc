"""MinHash signatures, banding and the components of links, shared by the near-duplicate operators."""

from __future__ import annotations

from array import array

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridrun.session import durable

#: The multipliers and offsets of the hash functions come from one generator with a fixed seed.
SEED = 20240229


def bands_for(threshold: float, recall: float, rows: int) -> int:
    """Least number of bands of ``rows`` rows that finds a pair at ``threshold`` with at least ``recall``."""
    return int(np.ceil(np.log1p(-recall) / np.log1p(-(threshold**rows))))


def coefficients(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(1, 1 << 63, count, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, count, dtype=np.uint64)


class _Digests(dict):
    """Hashes of words, each computed once."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def hashed_words(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts (str, UTF-8 bytes or None) in a row, and the number of words of each text."""
    digest, hashes, count = _Digests().__getitem__, array("Q"), []
    for t in texts:
        words = (t if isinstance(t, bytes) else t.encode()).split() if t else []  # bytes split at the blanks of WORD and no others
        count.append(len(words))
        hashes.extend(map(digest, words))
    return np.array(hashes, dtype=np.uint64), np.array(count, dtype=np.int64)


def shingles(word: np.ndarray, count: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of all texts in a row from their ``hashed_words``, which text each belongs to, and which texts have words.

    A text under ``n`` words has one shingle of all its words. Repeats are kept.
    """
    has = np.flatnonzero(count)
    owner = np.repeat(np.arange(len(count)), count)
    left = np.repeat(np.cumsum(count), count) - np.arange(len(word))  # words from here to the end of the text
    size = np.minimum(count, n)[owner]
    padded = np.concatenate([word, np.zeros(n, dtype=np.uint64)])
    with np.errstate(over="ignore"):
        key = size.astype(np.uint64)
        for i in range(n):
            step = (key ^ padded[i : i + len(word)]) * np.uint64(0x9E3779B97F4A7C15)
            key = np.where(i < size, step ^ (step >> np.uint64(32)), key)
    inside = left >= size
    return key[inside], owner[inside], has


def shingle_table(texts: list, n: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``shingles`` of texts."""
    return shingles(*hashed_words(texts), n)


def band_tables(texts: list, bands: int, rows: int, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes of the texts with words, one row each, and which texts these are."""
    return word_bands(*hashed_words(texts), bands, rows, n)


def word_bands(word: np.ndarray, count: np.ndarray, bands: int, rows: int, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """``band_tables`` from ``hashed_words``. MinHash values are minima over all shingles."""
    key, owner, has = shingles(word, count, n)
    if not len(has):
        return np.zeros((0, bands), dtype=np.int64), has
    starts = np.searchsorted(owner, has)
    a, b = coefficients(bands * rows)
    out = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(has), 1))
    with np.errstate(over="ignore"):
        for i in range(bands * rows):
            values = key * a[i] + b[i]
            values ^= values >> np.uint64(29)
            least = np.minimum.reduceat(values, starts)
            band = out[:, i // rows]
            band ^= least
            band *= np.uint64(0xC2B2AE3D27D4EB4F)
            band ^= band >> np.uint64(31)
    return out.view(np.int64), has


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(a, b)`` links between ids to ``(id, label)``, label the least id of the component.

    Every round each id takes the least label among its own and its neighbours', then the label of that label. The
    sums over a hub's links are combined before the shuffle; both joins have one row per id on one side, so a hub's
    rows may be split. Labels are cut from their lineage in the shared checkpoint folder after each round.
    """
    both = durable(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = durable(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).select(F.col("a").alias("id"), "label"))
    for _ in range(rounds):
        seen = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(seen.withColumnRenamed("a", "id"), "id", "left").select("id", "label", F.least("label", "near").alias("new"))
        jump = lower.alias("l").join(labels.alias("t"), F.col("l.new") == F.col("t.id"), "left").select("l.id", F.col("l.label").alias("was"), F.least(F.col("l.new"), F.col("t.label")).alias("label"))
        after = durable(jump)
        changed = after.where("label <> was").limit(1).count()
        labels = after.select("id", "label")
        if not changed:
            return labels
    raise RuntimeError(f"components still change after {rounds} rounds")
