"""Language identification with word-first backoff.

A word the model knows scores by its log frequency in each language. An unseen word backs off to its character
n-grams, from the longest length at which any of them is known down to single letters. A text takes the language with
the largest sum over all its words. The model is fitted on a sample of labelled rows whose size is bounded by a
parameter and kept to the most frequent words and n-grams per language, so that its size is bounded too.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridrun.llm.common import slices

LETTERS = re.compile(r"[^\W\d_]+")
LENGTHS = (5, 4, 3, 2, 1)
SMOOTH = 0.5
UNKNOWN = "und"


def in_training(doc_id: Column) -> Column:
    """Three of four documents, by crc32 of the id's text."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word with its ends marked; single letters go without marks."""
    marked = f"<{word}>" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def labelled_sample(docs: DataFrame, per_language: int) -> DataFrame:
    """Rows with a language in the training part: about ``per_language`` for each language, the same in every run."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & in_training(F.col("doc_id"))).select("doc_id", "lang", "text")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    return rows.join(counts, "lang").where(place < per_language / F.col("n")).select("lang", "text")


def gram_counts(sample: DataFrame) -> DataFrame:
    """``lang, n, gram, count``; n is 0 for whole words."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            by_lang: dict[str, Counter] = {}
            for lang, text in zip(part.column("lang").to_pylist(), texts, strict=True):
                by_lang.setdefault(lang, Counter()).update(LETTERS.findall(text.lower()))
            rows = []
            for lang, words in by_lang.items():
                rows += [(lang, 0, w, c) for w, c in words.items()]
                for n in LENGTHS:
                    found: Counter = Counter()
                    for w, c in words.items():
                        for g in grams(w, n):
                            found[g] += c
                    rows += [(lang, n, g, c) for g, c in found.items()]
            if rows:
                lang, n, gram, count = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(n, pa.int32()), pa.array(gram), pa.array(count, pa.int64())], names=["lang", "n", "gram", "count"])

    return sample.mapInArrow(scan, "lang string, n int, gram string, count bigint").groupBy("lang", "n", "gram").agg(F.sum("count").alias("count"))


@dataclass
class Model:
    """Learned languages, the row of every known word and n-gram, and log frequencies by row and language."""

    languages: list[str]
    rows: dict[int, dict[str, int]]
    logs: np.ndarray


def fit(docs: DataFrame, per_language: int = 2000, most_words: int = 30_000, most_grams: int = 8_000) -> Model:
    """Model of at most ``most_words`` words and ``most_grams`` n-grams of each length per language."""
    counts = gram_counts(labelled_sample(docs, per_language))
    top = Window.partitionBy("lang", "n").orderBy(F.col("count").desc(), "gram")  # over the bounded sample
    total = F.sum("count").over(Window.partitionBy("lang", "n"))
    kept = counts.withColumn("total", total).withColumn("place", F.row_number().over(top)).where((F.col("count") > 1) & (F.col("place") <= F.when(F.col("n") == 0, most_words).otherwise(most_grams)))
    found = kept.select("lang", "n", "gram", "count", "total").toArrow().to_pylist()
    languages = sorted({r["lang"] for r in found})
    place = {lang: i for i, lang in enumerate(languages)}
    rows: dict[int, dict[str, int]] = {n: {} for n in (0, *LENGTHS)}
    size = 0
    for r in sorted(found, key=lambda r: (r["n"], r["gram"])):
        if r["gram"] not in rows[r["n"]]:
            rows[r["n"]][r["gram"]] = size
            size += 1
    share = np.zeros((size, len(languages)))
    totals = np.ones((size, len(languages)))
    by_kind = {(r["n"], r["lang"]): r["total"] for r in found}
    for n, known in rows.items():
        at = np.fromiter(known.values(), dtype=np.int64, count=len(known))
        for lang in languages:
            totals[at, place[lang]] = by_kind.get((n, lang), 1)
    for r in found:
        share[rows[r["n"]][r["gram"]], place[r["lang"]]] = r["count"]
    return Model(languages, rows, np.log((share + SMOOTH) / (totals + SMOOTH * max(size, 1))))


class Lookup(dict):
    """Row of a word; an unseen word gets a row of its own by backoff."""

    def __init__(self, model: Model):
        super().__init__(model.rows[0])
        self.model, self.extra = model, []

    def __missing__(self, word: str) -> int:
        model = self.model
        vector = np.zeros(len(model.languages))
        for n in LENGTHS:
            known = model.rows[n]
            at = [known[g] for g in grams(word, n) if g in known]
            if at:
                vector = model.logs[at].mean(axis=0)
                break
        self.extra.append(vector)
        self[word] = at = len(model.logs) + len(self.extra) - 1
        return at


def predicted(model: Model, lookup: Lookup, texts: list) -> tuple[list[str], np.ndarray]:
    """Language and score (its share of the likelihood) of each text."""
    words = [LETTERS.findall(t.lower()) if t else [] for t in texts]
    counts = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    out, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    has = np.flatnonzero(counts)
    if not len(has) or not model.languages:
        return out, score
    rows = np.fromiter((lookup[w] for ws in words for w in ws), dtype=np.int64, count=int(counts.sum()))
    logs = np.vstack([model.logs, *lookup.extra]) if lookup.extra else model.logs
    sums = np.add.reduceat(logs[rows], np.cumsum(counts[has]) - counts[has], axis=0)
    best = sums.argmax(axis=1)
    score[has] = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
    for i, b in zip(has, best, strict=True):
        out[i] = model.languages[b]
    return out, score


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, lang_pred, score``.

    Null texts and texts without a letter are ``und`` with score 0, and so is everything if nothing was learned. A
    text of unknown letters only takes the first language with an even score. Whole texts count; nothing but the
    text is looked at. Rows with a null doc_id are predicted but never learned from (held_out false).
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by fit()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(sent.value)
        for part, texts in slices(batches):
            lang, score = predicted(sent.value, lookup, texts)
            if len(lookup.extra) > 100_000:
                lookup = Lookup(sent.value)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(~in_training(F.col("doc_id")), F.lit(False)).alias("held_out")
    return docs.select("doc_id", held, "text").mapInArrow(scan, "doc_id bigint, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, **bounds) -> DataFrame:
    """Fit on the labelled part of ``docs`` and predict all of it."""
    return predict(docs, fit(docs, **bounds))
