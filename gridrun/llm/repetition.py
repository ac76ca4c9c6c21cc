"""Quality rules on repetition inside a text: suffix-array repeats of words.

The words of a slice of texts are one sequence of numbers; ranks start with (text, word), so no repeat crosses
texts. Prefix doubling (numpy) ranks word strings of length 1, 2, 4, ...; strings that are unique leave after every
round. The suffixes that repeat for ``min_words`` end up in suffix order, the longest common prefix of neighbours
comes from the ranks by descending length, and every suffix starts the longer of its two intervals: these are the
maximal repeated substrings. Their spans are united per text; the rules limit the characters covered and the
longest repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridrun.llm.common import SMALL_SLICE, WORDS, slices

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
KINDS = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
         ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("n_covered_chars", pa.int64()), ("longest_repeat", pa.int64())]
SCHEMA = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, n_covered_chars bigint, longest_repeat bigint"


def repeat_lengths(ids: np.ndarray, text_of: np.ndarray, min_words: int = 8) -> np.ndarray:
    """For every position the longest word string that starts there and also elsewhere in its text (0 if below ``min_words``)."""
    n = len(ids)
    longest = np.zeros(n, dtype=np.int64)
    rank = np.full(n + 1, -1, dtype=np.int64)  # place in suffix order of the first suffix with the same prefix
    alive, base, length = np.arange(n), np.zeros(n, dtype=np.int64), 0
    keys = text_of.astype(np.int64) * (int(ids.max(initial=0)) + 1) + ids
    levels: list[tuple[int, np.ndarray]] = []
    while len(alive):
        order = np.argsort(keys, kind="stable")
        alive, keys, base = alive[order], keys[order], base[order]
        new, parent = np.ones(len(keys), dtype=bool), np.ones(len(keys), dtype=bool)
        new[1:], parent[1:] = keys[1:] != keys[:-1], base[1:] != base[:-1]
        at = np.arange(len(keys))
        rank[alive] = base + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(parent, at, 0))
        twice = ~new
        twice[:-1] |= ~new[1:]
        alive = alive[twice]  # unique suffixes have their final place
        length = 2 * length or 1
        level = np.full(n + 1, -1, dtype=np.int64)
        level[alive] = base = rank[alive]
        levels.append((length, level))
        keys = base * (n + 2) + rank[np.minimum(alive + length, n)] + 1
    if not levels:
        return longest
    suffixes = np.flatnonzero(max((x for x in levels if x[0] <= min_words), key=lambda x: x[0])[1] >= 0)
    suffixes = suffixes[np.argsort(rank[suffixes], kind="stable")]
    a, b = suffixes[:-1], suffixes[1:]
    lcp = np.zeros(len(a), dtype=np.int64)
    for step, level in reversed(levels):
        x, y = level[np.minimum(a + lcp, n)], level[np.minimum(b + lcp, n)]
        lcp[(x >= 0) & (x == y)] += step
    longest[a] = lcp
    longest[b] = np.maximum(longest[b], lcp)
    longest[longest < min_words] = 0
    return longest


def _suspects(hashes: np.ndarray, text_of: np.ndarray, n_texts: int, min_words: int) -> np.ndarray:
    """Texts in which some window of ``min_words`` words may occur twice, by a hash of the window; the others have no repeat."""
    out = np.zeros(n_texts, dtype=bool)
    n = len(hashes) - min_words + 1
    if n < 2:
        return out
    with np.errstate(over="ignore"):
        word = hashes.view(np.uint64)
        key = text_of[:n].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for i in range(min_words):
            key = key * np.uint64(0x100000001B3) + word[i : i + n]
    inside = text_of[:n] == text_of[min_words - 1 :]
    key, owner = key[inside], text_of[:n][inside]
    ordered = np.sort(key)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if len(again):
        again = np.unique(again)
        found = np.searchsorted(again, key)
        out[owner[again[np.minimum(found, len(again) - 1)] == key]] = True
    return out


def _lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(lines) - len(set(lines))


def _judged(texts: list, min_words: int, max_covered: float, max_longest: int) -> list[np.ndarray]:
    words = [WORDS.findall(t) if t else [] for t in texts]
    n_words = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    flat = [w for ws in words for w in ws]
    hashes = np.fromiter(map(hash, flat), dtype=np.int64, count=len(flat))
    chars = np.fromiter(map(len, flat), dtype=np.int64, count=len(flat))
    text_of = np.repeat(np.arange(len(texts)), n_words)
    reach = np.zeros(len(flat), dtype=np.int64)
    places = np.flatnonzero(_suspects(hashes, text_of, len(texts), min_words)[text_of]) if flat else []
    seen: dict[str, int] = {}
    ids = np.array([seen.setdefault(flat[i], len(seen)) for i in places], dtype=np.int64)
    reach[places] = repeat_lengths(ids, text_of[places], min_words) if len(ids) else 0
    covered = np.zeros(len(flat) + 1, dtype=np.int64)
    at = np.flatnonzero(reach)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + reach[at], -1)
    covered = (np.cumsum(covered)[:-1] > 0).astype(np.int64)
    per_text = lambda x: np.bincount(text_of, weights=x, minlength=len(texts)).astype(np.int64)
    word_chars, repeat_words, covered_chars = per_text(chars), per_text(covered), per_text(covered * chars)
    longest = np.zeros(len(texts), dtype=np.int64)
    np.maximum.at(longest, text_of, reach)
    symbols = np.array([sum(map(t.count, SYMBOLS)) if t else 0 for t in texts], dtype=np.int64)
    lines = np.array([_lines(t) if t else 0 for t in texts], dtype=np.int64)
    failed = (n_words < 20) | (100 * repeat_words > 30 * n_words)
    kept = ~failed & (covered_chars <= max_covered * word_chars) & (longest <= max_longest)
    return [n_words, word_chars, symbols, lines, repeat_words, failed, kept, covered_chars, longest]


def quality_rules(docs: DataFrame, min_words: int = 8, max_covered: float = 0.35, max_longest: int = 100) -> DataFrame:
    """One row per row of ``docs``: the base measures, ``kept``, the characters covered by repeats and the longest repeat in words.

    Rejected are texts under 20 words, with more than 30 % of their words in repeated 8-word windows, with more than
    ``max_covered`` of their word characters in repeats of ``min_words`` words or more, or with a repeat longer than
    ``max_longest`` words. Null and empty texts have no words and are rejected. Whole texts are judged, whatever
    their length; texts are never shuffled. No rows in, no rows out; further columns of ``docs`` are ignored.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, chars=SMALL_SLICE):
            columns = [part.column("doc_id").cast(pa.int64()), *_judged(texts, min_words, max_covered, max_longest)]
            yield pa.RecordBatch.from_arrays([pa.array(x, type=kind) for x, (_, kind) in zip(columns, KINDS, strict=True)], names=[name for name, _ in KINDS])

    return docs.select("doc_id", "text").mapInArrow(judge, SCHEMA)


def keep_quality(docs: DataFrame, **limits) -> DataFrame:
    """The rows of ``docs``, all columns, that ``quality_rules`` keeps; one pass, no shuffle."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, chars=SMALL_SLICE):
            yield part.filter(pa.array(_judged(texts, limits.get("min_words", 8), limits.get("max_covered", 0.35), limits.get("max_longest", 100))[6]))

    return docs.mapInArrow(judge, docs.schema)


#: A repeat over 100 words is a window of 101 words found twice.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
lines AS (
  SELECT doc_id, len(ls) - len(list_distinct(ls)) AS n_dup_lines
  FROM (SELECT doc_id, [x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM d)),
tokens AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
wins AS (SELECT doc_id, unnest(generate_series(1, len(ws) - 7)) AS i, ws FROM d WHERE len(ws) >= 8),
keyed AS (SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS k FROM wins),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM keyed) WHERE c > 1),
cover AS (SELECT DISTINCT doc_id, i + o AS i FROM twice, range(8) r(o)),
covered AS (SELECT c.doc_id, count(*) AS n, sum(length(t.w)) AS chars FROM cover c JOIN tokens t ON c.doc_id = t.doc_id AND c.i = t.i GROUP BY c.doc_id),
long AS (
  SELECT DISTINCT doc_id FROM (
    SELECT doc_id, count(*) OVER (PARTITION BY doc_id, k) AS c
    FROM (SELECT doc_id, hash(ws[i:i+100]) AS k FROM (SELECT doc_id, unnest(generate_series(1, len(ws) - 100)) AS i, ws FROM d WHERE len(ws) >= 101)))
  WHERE c > 1),
m AS (
  SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(chars, 0) AS BIGINT) AS n_covered_chars, o.doc_id IS NOT NULL AS too_long
  FROM d JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN long o ON d.doc_id = o.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_covered_chars <= 0.35 * word_chars AND NOT too_long AS kept,
       n_covered_chars
FROM m
"""
