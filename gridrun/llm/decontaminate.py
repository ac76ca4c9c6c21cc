"""Benchmark decontamination by spaced-seed hashing.

A seed is a mask over a few consecutive tokens in which some positions don't count, so that a substituted token at
such a position leaves the hash as it was. Seeds of the benchmark form a hash table (a Spark table) and a Bloom filter
of fixed size, the only thing that is broadcast. The scan of the documents hashes every position under every mask and
emits those that pass the filter, with the token hashes around them. A join on the seed hash finds the item and the
place in it; then tokens around the hit are compared along the alignment, and a window that agrees in
``min_agree`` of its tokens or more is an overlap.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridrun.llm.common import SMALL_SLICE, free_name, slices

#: Spaced seeds: '1' counts, '0' is ignored.
MASKS = ("111010011", "110110101", "101100111")
SPAN = 9
WINDOW = 13
#: The filter has 2^bits bits, by the number of seeds, between these bounds: 512 KB to 32 MB.
BLOOM_BITS = (22, 28)
HITS = 50_000
TOKENS = re.compile(r"\w+")
HIT = "doc_id bigint, doc_key bigint, seed bigint, mask int, pos int, around binary"
SEED = "item_id bigint, seed bigint, mask int, pos int, n_tokens int, around binary"


def token_hashes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-case tokens of all texts in a row, and the number of tokens of each text."""
    known: dict[str, int] = {}
    out, counts = [], []
    digest = xxhash.xxh3_64_intdigest
    for t in texts:
        tokens = TOKENS.findall(t.lower()) if t else []
        counts.append(len(tokens))
        for w in tokens:
            h = known.get(w)
            if h is None:
                h = known[w] = digest(w) or 1
            out.append(h)
    return np.array(out, dtype=np.uint64), np.array(counts, dtype=np.int64)


def masks_for(masks: tuple[str, ...], n: int) -> list[tuple[int, str]]:
    """Masks of an item of ``n`` tokens: the spaced ones, or for a shorter item one that counts all its tokens."""
    return [(i, m) for i, m in enumerate(masks)] if n >= SPAN else [(len(masks) + n, "1" * n)] if n >= 3 else []


def seeds_at(tokens: np.ndarray, mask: str, number: int) -> np.ndarray:
    """Seed hash at every position that has room for the mask (64 bits, never 0)."""
    n = len(tokens) - len(mask) + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        h = np.full(n, (number + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
        for i, bit in enumerate(mask):
            if bit == "1":
                h = (h ^ tokens[i : i + n]) * np.uint64(0xC2B2AE3D27D4EB4F)
                h ^= h >> np.uint64(31)
    return h


def _windows(tokens: np.ndarray, at: np.ndarray, reach: int) -> np.ndarray:
    """Token hashes from ``reach`` before to ``SPAN + reach`` after each position; 0 outside the text."""
    padded = np.concatenate([np.zeros(reach, dtype=np.uint64), tokens, np.zeros(SPAN + reach, dtype=np.uint64)])
    return padded[at[:, None] + np.arange(SPAN + 2 * reach)[None, :]]


def benchmark_seeds(benchmark: DataFrame, masks: tuple[str, ...] = MASKS, window: int = WINDOW) -> DataFrame:
    """One row per item, mask and position."""
    reach = window - 1

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, chars=SMALL_SLICE):
            tokens, counts = token_hashes(texts)
            ends = np.cumsum(counts)
            cols: list[list] = [[], [], [], [], [], []]
            for item, n, end in zip(part.column("item_id").to_pylist(), counts, ends, strict=True):
                own = tokens[end - n : end]
                for number, mask in masks_for(masks, int(n)):
                    seeds = seeds_at(own, mask, number)
                    around = _windows(own, np.arange(len(seeds)), reach)
                    cols[0] += [item] * len(seeds)
                    cols[1] += seeds.view(np.int64).tolist()
                    cols[2] += [number] * len(seeds)
                    cols[3] += range(len(seeds))
                    cols[4] += [int(n)] * len(seeds)
                    cols[5] += [x.tobytes() for x in around]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds, strict=True)], names=["item_id", "seed", "mask", "pos", "n_tokens", "around"])

    return benchmark.select("item_id", "text").mapInArrow(scan, SEED)


def _bit(seeds: np.ndarray, size: int) -> np.ndarray:
    return (seeds >> np.uint64(65 - size.bit_length())).astype(np.int64)


def seed_filter(seeds: DataFrame) -> np.ndarray:
    """Bit array over the seeds. Its size has a fixed bound, so at most 2^22 words of it reach the driver; a seed it lets through in vain finds no partner in the join."""
    bits = min(max(int(16 * seeds.count()).bit_length(), BLOOM_BITS[0]), BLOOM_BITS[1])
    bit = F.shiftrightunsigned("seed", 64 - bits)
    words = seeds.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(seed, {64 - bits}) & 63 AS INT))")).alias("bits"))
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    for r in words.toLocalIterator():
        out[r["word"]] = r["bits"] & 0xFFFFFFFFFFFFFFFF
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def seed_hits(docs: DataFrame, benchmark_lengths: list[int], bloom: np.ndarray, masks: tuple[str, ...] = MASKS, window: int = WINDOW) -> DataFrame:
    """Positions of the documents whose seed may be one of the benchmark's, with the tokens around."""
    reach = window - 1
    packed = docs.sparkSession.sparkContext.broadcast(np.packbits(bloom))
    kinds = [(i, m) for i, m in enumerate(masks)] + [(len(masks) + n, "1" * n) for n in benchmark_lengths]

    def emitted(part, tokens, starts, counts, owner, number, at, seeds) -> pa.RecordBatch:
        own = owner[at]
        around = _windows(tokens, at, reach)
        place = at[:, None] + np.arange(-reach, SPAN + reach)[None, :]
        around[(place < starts[own][:, None]) | (place >= (starts + counts)[own][:, None])] = 0
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id").cast(pa.int64()).take(pa.array(own)), part.column("doc_key").take(pa.array(own)), pa.array(seeds.view(np.int64)), pa.array(number, type=pa.int32()),
             pa.array((at - starts[own]).astype(np.int32)), pa.array([x.tobytes() for x in around], type=pa.binary())],
            names=["doc_id", "doc_key", "seed", "mask", "pos", "around"],
        )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allowed = np.unpackbits(packed.value).astype(bool)
        for part, texts in slices(batches, chars=SMALL_SLICE):
            tokens, counts = token_hashes(texts)
            starts = np.cumsum(counts) - counts
            owner = np.repeat(np.arange(len(texts)), counts)
            found = []
            for number, mask in kinds:
                seeds = seeds_at(tokens, mask, number)
                at = np.flatnonzero(allowed[_bit(seeds, len(allowed))])
                at = at[owner[at] == owner[at + len(mask) - 1]]  # a seed lies in one text
                found.append((np.full(len(at), number), at, seeds[at]))
            number, at, seeds = (np.concatenate([f[i] for f in found]) for i in range(3))
            for few in range(0, len(at), HITS):
                yield emitted(part, tokens, starts, counts, owner, number[few : few + HITS], at[few : few + HITS], seeds[few : few + HITS])

    return docs.select("doc_id", text_key().alias("doc_key"), "text").mapInArrow(scan, HIT)


def text_key():
    """Tells rows with the same doc_id and other texts apart."""
    return F.xxhash64("text")


def overlaps(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, window: int = WINDOW, min_agree: float = 0.8) -> DataFrame:
    """Contaminated documents: one row per document and item with the most tokens agreeing in a window.

    ``doc_id, doc_key, item_id, n_agree, window, first_pos``: the window is ``window`` tokens, or the whole item where
    it is shorter; it must agree in ``min_agree`` of its tokens at equal places, so that substituted tokens are
    tolerated while a text that only shares common words is left alone. Tokens are lower-case ``\\w+``. Items under 3
    tokens match nothing. Null and empty texts have no tokens; repeated rows give one row. An empty benchmark or no
    documents give no rows. Every position of every text is hashed.
    """
    seeds = benchmark_seeds(benchmark, masks, window)
    lengths = sorted(r[0] for r in seeds.where(F.col("n_tokens") < SPAN).select("n_tokens").distinct().collect())  # 3 to SPAN - 1 at most
    hits = seed_hits(docs, lengths, seed_filter(seeds), masks, window)
    pairs = hits.alias("h").join(seeds.alias("s"), ["seed", "mask"]).select("h.doc_id", "h.doc_key", "s.item_id", "s.n_tokens", F.col("h.pos").alias("pos"), F.col("h.around").alias("a"), F.col("s.around").alias("b"))
    reach = window - 1

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint64).reshape(batch.num_rows, -1) for c in ("a", "b"))
            width = np.minimum(batch.column("n_tokens").to_numpy(), window)
            sums = np.zeros((len(a), a.shape[1] + 1), dtype=np.int32)
            np.cumsum((a == b) & (b != 0), axis=1, out=sums[:, 1:])
            inside = np.zeros_like(sums)
            np.cumsum(b != 0, axis=1, out=inside[:, 1:])
            best, at = np.zeros(len(a), dtype=np.int64), np.zeros(len(a), dtype=np.int64)
            for w in np.unique(width):
                rows = np.flatnonzero(width == w)
                agree = sums[rows, w:] - sums[rows, :-w]
                agree[inside[rows, w:] - inside[rows, :-w] < w] = 0  # the window lies in the item
                best[rows], at[rows] = agree.max(axis=1), agree.argmax(axis=1)
            ok = best >= np.ceil(min_agree * width - 1e-9)
            cols = [batch.column("doc_id"), batch.column("doc_key"), batch.column("item_id"), pa.array(best), pa.array(width.astype(np.int64)), pa.array(batch.column("pos").to_numpy().astype(np.int64) + at - reach)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "doc_key", "item_id", "n_agree", "window", "first_pos"]).filter(pa.array(ok))

    found = pairs.mapInArrow(compare, "doc_id bigint, doc_key bigint, item_id bigint, n_agree bigint, window bigint, first_pos bigint")
    return found.groupBy("doc_id", "doc_key", "item_id").agg(F.max("n_agree").alias("n_agree"), F.max("window").alias("window"), F.min(F.greatest(F.col("first_pos"), F.lit(0))).alias("first_pos"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, that overlap no item of the benchmark."""
    bad = overlaps(docs, benchmark, **options).select("doc_id", "doc_key").distinct()
    mark = free_name(docs, "_key")
    keyed = docs.withColumn(mark, text_key())
    # a null doc_id equals a null doc_id here
    return keyed.alias("d").join(bad.alias("b"), F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col(f"d.{mark}") == F.col("b.doc_key")), "left_anti").drop(mark)
