"""Substring dedup by paragraph MinHash banding.

A paragraph is a line of ``min_words`` words or more. Equal paragraphs are one unit; units meet by MinHash bands tuned
for recall, are verified by exact Jaccard of their word shingles (see ``jaccard``), and of every component of links the
first paragraph in (doc_id, line) order stays. Passages need not be whole lines: every stretch of ``window`` words of a
text, over line ends too, also counts as a paragraph of one band with one row, the least hash of its ``shingle``
consecutive words. Stretches that meet in it are compared by the names of all their words (128 bits), and every stretch
that a smaller document has goes whole, so of a shared passage the maximal run goes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridrun.llm.common import SMALL_SLICE, WORDS, slices, stored
from gridrun.llm.jaccard import near_links, small
from gridrun.llm.minhash import bands_for, hashed_words, word_bands

MIN_WORDS, WINDOW, SHINGLE = 10, 50, 20
RUN = 32  # stretches in one row
ROWS, RECALL, THRESHOLD, WORD_SHINGLE = 2, 0.9999, 0.8, 5


def lines(docs: DataFrame) -> DataFrame:
    """``u, text``: all lines; ``u`` tells texts apart."""
    split = docs.where(F.col("doc_id").isNotNull()).select(F.explode(F.split("text", "\n", -1)).alias("text"))
    return split.select(F.xxhash64("text").alias("u"), "text")


def banded_lines(docs: DataFrame, min_words: int, bands: int, rows: int, n: int) -> DataFrame:
    """``doc_id, line, u, chars, bh``: the paragraphs by number of the line, their UTF-8 bytes and band hashes; those found again in a slice come without hashes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, chars=SMALL_SLICE):
            split = [t.encode().split(b"\n") if t is not None else [] for t in texts]
            held = np.array([len(x) for x in split], dtype=np.int64)
            every = [x for s in split for x in s]
            word, count = hashed_words(every)
            keep = np.flatnonzero(count >= min_words)
            u = np.array([xxhash.xxh64_intdigest(every[i], 42) for i in keep.tolist()], dtype=np.uint64).view(np.int64)  # as xxhash64 of Spark
            first = np.unique(u, return_index=True)[1]
            new = np.zeros(len(every), dtype=bool)
            new[keep[first]] = True
            hashes, _ = word_bands(word[np.repeat(new, count)], count[new], bands, rows, n)
            own = np.zeros(len(keep), dtype=np.int64)
            own[first] = bands
            # the bands of a paragraph are in a row, in the order of the lines, as the new ones are
            offsets = pa.array(np.concatenate([[0], np.cumsum(own)]).astype(np.int32))
            bh = pa.ListArray.from_arrays(offsets, pa.array(hashes.reshape(-1)))
            doc = np.repeat(np.arange(len(held)), held)
            line = np.arange(len(every)) - np.repeat(np.cumsum(held) - held, held)
            chars = np.array([len(every[i]) for i in keep.tolist()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()).take(pa.array(doc[keep])), pa.array(line[keep].astype(np.int32)), pa.array(u), pa.array(chars), bh], names=["doc_id", "line", "u", "chars", "bh"])

    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInArrow(scan, "doc_id bigint, line int, u bigint, chars bigint, bh array<bigint>")


def _names(key: np.ndarray, words: int) -> np.ndarray:
    """Names of the runs of ``words`` words, by doubling; ``key`` names the single words."""
    length = 1
    with np.errstate(over="ignore"):
        while length < words:
            step = min(length, words - length)
            key = (key[:-step] ^ (key[step:] * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xC2B2AE3D27D4EB4F)
            key ^= key >> np.uint64(29)
            length += step
    return key


def _least(words: np.ndarray, count: np.ndarray, window: int, shingle: int) -> np.ndarray:
    """For every stretch of ``window`` words the least name of its shingles; 0 where it leaves its text."""
    least, length, width = _names(words, shingle), 1, window - shingle + 1
    while length < width:
        step = min(length, width - length)
        least = np.minimum(least[:-step], least[step:])
        length += step
    text_of = np.repeat(np.arange(len(count)), count)
    return np.where(text_of[: len(least)] == text_of[window - 1 :], least, np.uint64(0))


def slice_marks(texts: list, window: int, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, word, hash)`` of the selected shingles of a slice of texts: the least of every stretch of ``window`` words."""
    words, count = hashed_words(texts)
    none = np.zeros(0, dtype=np.int64)
    if len(words) < window:
        return none, none, none
    key, least, length, width = _names(words, shingle), _least(words, count, window, shingle), 1, window - shingle + 1
    # a shingle is selected if it is the least of a stretch that holds it, so if the greatest of these least ones is its own
    most = np.concatenate([np.zeros(width - 1, dtype=np.uint64), least, np.zeros(width - 1, dtype=np.uint64)])
    while length < width:
        step = min(length, width - length)
        most = np.maximum(most[:-step], most[step:])
        length += step
    at = np.flatnonzero((most == key) & (most != 0))
    text_of = np.repeat(np.arange(len(count)), count)[at]
    return text_of, at - (np.cumsum(count) - count)[text_of], key[at].view(np.int64)


def marks(docs: DataFrame, window: int, shingle: int) -> DataFrame:
    """``mark, doc_id``: the selected shingles of all texts, each once per text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            owner, _, mark = slice_marks(texts, window, shingle)
            order = np.lexsort((mark, owner))
            owner, mark = owner[order], mark[order]
            new = np.ones(len(mark), dtype=bool)
            new[1:] = (mark[1:] != mark[:-1]) | (owner[1:] != owner[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(mark[new]), part.column("doc_id").cast(pa.int64()).take(pa.array(owner[new]))], names=["mark", "doc_id"])

    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInArrow(scan, "mark bigint, doc_id bigint")


def segments(docs: DataFrame, window: int, shingle: int) -> DataFrame:
    """``doc_id, key, mark, start, n, s1, s2, names``: up to RUN stretches in a row under one of the ``marks`` of their document.

    ``s1, s2`` name all words of the segment, ``names`` the stretches (two numbers each); a segment found again in a
    slice comes without ``names``. ``key`` tells texts with one doc_id apart.
    """
    half = (window + 1) // 2

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            words, count = hashed_words(texts)
            if len(words) < window:
                continue
            wanted = np.unique(np.array(pa.compute.list_flatten(part.column("marks")), dtype=np.int64))
            least = _least(words, count, window, shingle)
            text_of = np.repeat(np.arange(len(count)), count)
            new = np.ones(len(least), dtype=bool)
            new[1:] = (least[1:] != least[:-1]) | (text_of[1 : len(least)] != text_of[: len(least) - 1])
            start = np.flatnonzero(new)
            n = np.diff(np.append(start, len(least)))
            keep = (least[start] != 0) & np.isin(least[start].view(np.int64), wanted)
            start, n = start[keep], n[keep]
            pieces = -(-n // RUN)
            order = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start, n = np.repeat(start, pieces) + order * RUN, np.minimum(np.repeat(n, pieces) - order * RUN, RUN)
            rank = _names(words, half)
            pairs = np.stack([rank[: len(least)], rank[window - half : window - half + len(least)]], axis=1)
            seen, s1, s2, names = set(), [], [], []
            for a, k in zip(start.tolist(), n.tolist(), strict=True):
                h = xxhash.xxh3_128_digest(words[a : a + k + window - 1].tobytes())
                s1.append(int.from_bytes(h[:8], "little", signed=True))
                s2.append(int.from_bytes(h[8:], "little", signed=True))
                names.append(None if h in seen else pairs[a : a + k].tobytes())
                seen.add(h)
            own = text_of[start]
            doc, key = (part.column(c).take(pa.array(own)) for c in ("doc_id", "key"))
            yield pa.RecordBatch.from_arrays(
                [doc, key, pa.array(least[start].view(np.int64)), pa.array(start - (np.cumsum(count) - count)[own]), pa.array(n), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(names, pa.binary())],
                names=["doc_id", "key", "mark", "start", "n", "s1", "s2", "names"])

    return docs.mapInArrow(scan, "doc_id bigint, key bigint, mark bigint, start bigint, n bigint, s1 bigint, s2 bigint, names binary")


def stretch_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per stretch of the segments: ``s1, s2, first, i, a, b``."""
    for batch in batches:
        data = batch.column("names").to_pylist()
        n = np.array([len(x) // 16 for x in data], dtype=np.int64)
        pairs = np.frombuffer(b"".join(data), dtype=np.int64).reshape(-1, 2)
        row = np.repeat(np.arange(len(n)), n)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        cols = [batch.column(c).take(pa.array(row)) for c in ("s1", "s2", "first")]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(inside.astype(np.int32)), pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], names=["s1", "s2", "first", "i", "a", "b"])


def repeated_runs(docs: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, key, starts, firsts``: stretches of ``window`` words that a smaller document has too, and the least such documents.

    Equal stretches share a mark, so only stretches under a mark of several documents are compared: segments as a
    whole first, and where a mark has segments that differ, their stretches one by one.
    """
    found = stored(marks(docs, window, shingle))
    shared = found.groupBy("mark").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi").select("mark")
    mine = stored(found.join(small(stored(shared)), "mark").groupBy("doc_id").agg(F.collect_set("mark").alias("marks")))
    source = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("key"), "text")
    touched = source.join(small(mine.select("doc_id")), "doc_id", "left_semi").join(mine, "doc_id")
    placed = stored(segments(touched, window, shingle))
    kinds = stored(placed.groupBy("s1", "s2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.min("mark").alias("mark"), F.first("names", ignorenulls=True).alias("names")))
    several = kinds.groupBy("mark").agg(F.min("s1").alias("lo"), F.max("s1").alias("hi")).where("lo <> hi").select("mark")
    several = small(stored(several))
    each = stored(kinds.join(several, "mark").select("s1", "s2", "first", "names").mapInArrow(stretch_names, "s1 bigint, s2 bigint, first bigint, i int, a bigint, b bigint"))
    least = each.groupBy("a", "b").agg(F.min("first").alias("least"), F.max("first").alias("most")).where("least <> most").select("a", "b", "least")
    earlier = each.join(small(stored(least)), ["a", "b"]).where("first > least").groupBy("s1", "s2").agg(F.map_from_entries(F.collect_list(F.struct("i", "least"))).alias("earlier"))
    per_kind = kinds.join(stored(earlier), ["s1", "s2"], "left").where("first <> last OR earlier IS NOT NULL").select("s1", "s2", "first", "earlier")
    every = F.transform(F.sequence(F.lit(0), (F.col("n") - 1).cast("int")), lambda i: F.struct((F.col("start") + i).alias("start"), F.coalesce(F.col("earlier")[i], F.col("first")).alias("first")))
    gone = placed.drop("names").join(stored(per_kind), ["s1", "s2"]).select("doc_id", "key", F.filter(every, lambda x: x["first"] < F.col("doc_id")).alias("gone")).where(F.size("gone") > 0)
    listed = gone.groupBy("doc_id", "key").agg(F.flatten(F.collect_list("gone")).alias("gone"))
    return listed.select("doc_id", "key", F.col("gone.start").alias("starts"), F.array_distinct(F.col("gone.first")).alias("firsts"))


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, threshold: float = THRESHOLD, rows: int = ROWS, recall: float = RECALL) -> DataFrame:
    """``doc_id, line, first``: paragraphs that are not the first of their class, and the document of the first."""
    found = stored(banded_lines(docs, min_words, bands_for(threshold, recall, rows), rows, WORD_SHINGLE))
    places = found.select("doc_id", "line", "u")
    _, labels = near_links(lines(docs), found.select("u", F.explode("bh").alias("bh")), threshold, WORD_SHINGLE, found.select("u", "chars"))
    copies = places.groupBy("u").agg(F.min(F.struct("doc_id", "line")).alias("least"), F.count("*").alias("n"))
    classed = copies.join(small(stored(labels)), "u", "left").where("n > 1 OR label IS NOT NULL").withColumn("label", F.coalesce("label", "u"))
    kept = stored(classed)
    firsts = kept.groupBy("label").agg(F.min("least").alias("first"))
    per_unit = stored(kept.join(firsts, "label").select("u", "first"))
    out = places.join(small(per_unit), "u").where(F.struct("doc_id", "line") > F.col("first"))
    return out.select("doc_id", "line", F.col("first.doc_id").alias("first"))


def merged(starts: list[int], window: int) -> list[tuple[int, int]]:
    """Runs of words ``(first, one after the last)`` that the stretches at ``starts`` cover; runs that touch are one."""
    out: list[tuple[int, int]] = []
    for s in sorted(starts):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s + window))
        else:
            out.append((s, s + window))
    return out


def cut_text(text: str, gone_lines: list[int], runs: list[tuple[int, int]]) -> tuple[str, int]:
    """The text without the lines and the runs of words, and the number of words that went."""
    starts = [0] + [m.end() for m in re.finditer("\n", text)]
    ends = [*starts[1:], len(text)]
    places = [m.span() for m in WORDS.finditer(text)] if runs else []
    cuts = sorted([*((starts[i], ends[i]) for i in gone_lines), *((places[a][0], places[b - 1][1]) for a, b in runs)])
    out, at, words = [], 0, 0
    for a, b in cuts:
        a = max(a, at)
        if b > a:
            out.append(text[at:a])
            words += len(WORDS.findall(text[a:b]))
            at = b
    out.append(text[at:])
    return "".join(out), words


def dedup_paragraphs(docs: DataFrame, min_words: int = MIN_WORDS, window: int = WINDOW, shingle: int = SHINGLE, **tuning) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_removed_lines, n_removed_spans, n_removed_words, first_docs, text`` (what stays).

    A word goes with its paragraph, or if a stretch of ``window`` words that covers it, line ends counting as blanks,
    is also in a document with a smaller doc_id; stretches are judged on the input, overlaps count, and what lies
    between the words of a run goes with it. ``n_removed_spans`` counts such runs. ``first_docs`` lists the least
    documents that hold what was removed here. Repeats inside one document count for whole paragraphs, not for
    passages. Null texts stay null; lines under ``min_words`` words stay unless a passage covers them. Rows with a null doc_id stay whole. Repeated rows with the same doc_id are one
    document. No rows in, no rows out.
    """
    by_line = repeated_lines(docs, min_words, **tuning).groupBy("doc_id").agg(F.collect_set("line").alias("lines"), F.collect_set("first").alias("f1"))
    by_run = repeated_runs(docs, window, shingle).groupBy("doc_id").agg(F.collect_list(F.struct("key", "starts")).alias("runs"), F.array_distinct(F.flatten(F.collect_list("firsts"))).alias("f2"))
    both = by_line.join(by_run, "doc_id", "full").select("doc_id", "lines", "runs", F.array_sort(F.array_union(F.coalesce("f1", F.array().cast("array<bigint>")), F.coalesce("f2", F.array().cast("array<bigint>")))).alias("first_docs"))
    found = stored(both)
    mine = small(found.select("doc_id"))
    source = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            cols = [part.column(c).to_pylist() for c in ("key", "lines", "runs")]
            rows = []
            for text, key, gone, found_runs in zip(texts, *cols, strict=True):
                runs = merged([s for r in found_runs or [] if r["key"] == key for s in r["starts"]], window)
                rows.append((len(gone or []), len(runs), *cut_text(text or "", gone or [], runs)[::-1]))
            lines_gone, n_spans, words, kept = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lines_gone, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(words, pa.int64()), part.column("first_docs"), pa.array(kept, pa.string())],
                                             names=["doc_id", "n_removed_lines", "n_removed_spans", "n_removed_words", "first_docs", "text"])

    changed = source.join(mine, "doc_id", "left_semi").join(found, "doc_id").mapInArrow(cut, "doc_id bigint, n_removed_lines bigint, n_removed_spans bigint, n_removed_words bigint, first_docs array<bigint>, text string")
    zero = F.lit(0).cast("long")
    whole = source.join(mine, "doc_id", "left_anti").select("doc_id", zero.alias("n_removed_lines"), zero.alias("n_removed_spans"), zero.alias("n_removed_words"), F.array().cast("array<bigint>").alias("first_docs"), "text")
    return changed.unionByName(whole)
