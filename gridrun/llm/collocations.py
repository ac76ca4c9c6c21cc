"""Phrase collocations by merged stripes.

A stripe belongs to a prefix of words and counts the words that follow it. Stripes are built in numpy within a task and
merged by adding them up cell by cell, so that a prefix that stands everywhere is spread over its next words. From the
merged stripes come all counts: a cell is the count of a phrase, the cell of its prefix in the next shorter stripe is
the prefix total, and the largest cell among a phrase's extensions by one word decides whether a longer one subsumes it.

Before the stripes are built, rounds of counts by hash find what can be frequent: words first, then phrases of k words
whose two parts of k - 1 words are. What is frequent goes to the next round as a Bloom filter of fixed size. A filter
or a hash can only let too much through; the stripes count words themselves, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridrun.llm.common import SMALL_SLICE, slices, stored
from gridrun.operators.ranking import top_k

#: Bits and hash functions of the filter of a round: 8 MB, good for about ten million frequent phrases.
FILTER_BITS, FILTER_HASHES = 26, 3
#: Bytes of text worked on at once, cut between pieces, phrases that a task holds before it sends them on, and phrases it sends at once.
#: All three bound a worker's memory beside the executor's heap, not the result.
BLOCK, HELD, SENT = 400_000, 400_000, 50_000
#: Phrases that a task knows by name before it sends its stripes on; a phrase is sent once per time that this many are reached.
NAMED = 500_000
#: Parts of the scan that one task builds stripes of: every task sends each frequent phrase it has, so few large ones send less.
STRIPE_PARTS = 4
SPACE, END = 32, 10
#: Bytes of a text: A-Z small, line ends and punctuation end a piece, a tab is a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else END if b in b".,;:!?\n\x0b\x0c\r" else SPACE if b == 9 else b for b in range(256))
MIX, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * MIX
        return h ^ (h >> np.uint64(29))


#: By byte: whether it is between words, and its value in a hash.
BLANK = np.isin(np.arange(256), (SPACE, END))
VALUE = np.where(BLANK, np.uint64(0), mixed(np.arange(1, 257, dtype=np.uint64)))


@cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of STEP and of its inverse."""
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.r_[np.uint64(1), np.full(n - 1, f, np.uint64)]) for f in (STEP, np.uint64(pow(int(STEP), -1, 1 << 64))))


class Words:
    """The words of a block: where each starts and ends in the block's bytes, its piece, its language, and its hash, which takes the language in."""

    def __init__(self, raw: bytes, sizes: np.ndarray, langs: np.ndarray, names: list[str]):
        """``raw`` holds folded texts one after another, each with an END; ``langs`` has the place in ``names`` of each."""
        self.raw, self.names, self.known = raw, names, {}
        at = np.frombuffer(raw, dtype=np.uint8)
        blank = BLANK[at]
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        edge = edge if blank[0] else np.r_[0, edge]
        start, self.end = edge[::2], edge[1::2]
        self.start = start
        self.piece = np.searchsorted(np.flatnonzero(at == END), start)
        self.lang = langs[np.searchsorted(np.cumsum(sizes), start, side="right")]
        up, down = powers(1 << max(len(at) - 1, 1).bit_length())
        tags = np.array([xxhash.xxh3_64_intdigest(n) for n in names], dtype=np.uint64)
        with np.errstate(over="ignore"):
            total = np.add.reduceat(VALUE[at] * up[: len(at)], start) if len(start) else np.zeros(0, np.uint64)
            self.word = mixed(total * down[start] ^ tags[self.lang])

    def phrases(self, k: int) -> np.ndarray:
        """Hashes of the phrases of ``k`` words by first word; those that leave their piece are included."""
        if k == 1:
            return self.word
        if k not in self.known:
            last = self.word[k - 1 :]
            with np.errstate(over="ignore"):
                self.known[k] = mixed(self.phrases(k - 1)[: len(last)] * STEP + last)
        return self.known[k]

    def whole(self, k: int) -> np.ndarray:
        """Which of the phrases of ``k`` words lie in one piece."""
        n = max(0, len(self.word) - k + 1)
        return self.piece[:n] == self.piece[k - 1 : k - 1 + n]

    def text(self, i: int) -> str:
        return self.raw[self.start[i] : self.end[i]].decode("utf-8", "replace")


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    """Words of all texts in blocks of about BLOCK bytes; a longer text goes on in the next block after the end of a piece."""
    for part, texts in slices(batches, chars=SMALL_SLICE):
        names = part.column("lang").unique().to_pylist()
        place = {n: i for i, n in enumerate(names)}
        held, sizes, langs, total = [], [], [], 0
        for lang, text in zip(part.column("lang").to_pylist(), texts, strict=True):
            raw = (text or "").encode("utf-8", "replace").translate(FOLD) + b"\n"
            at = 0
            while at < len(raw):
                cut = raw.rfind(b"\n", at, at + BLOCK) + 1 or raw.index(b"\n", at + BLOCK - 1) + 1 if len(raw) - at > BLOCK else len(raw)
                held.append(raw[at:cut])
                sizes.append(cut - at)
                langs.append(place[lang])
                total += cut - at
                at = cut
                if total >= BLOCK:
                    yield Words(b"".join(held), np.array(sizes), np.array(langs), names)
                    held, sizes, langs, total = [], [], [], 0
        if held:
            yield Words(b"".join(held), np.array(sizes), np.array(langs), names)


def bits_of(h: np.ndarray, i: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(h + np.uint64(i + 1) * MIX) >> np.uint64(64 - FILTER_BITS)


def passes(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes the filter lets through."""
    ok = np.ones(len(h), dtype=bool)
    for i in range(FILTER_HASHES):
        b = bits_of(h, i)
        ok &= (known[(b >> np.uint64(3)).astype(np.int64)] >> (b & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return ok


def filter_of(frequent: DataFrame) -> Broadcast:
    """Bloom filter of the ``key`` column, sent to all executors; at most 2^(FILTER_BITS - 6) rows come to the driver."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column("key").to_numpy().view(np.uint64)
            at = np.concatenate([bits_of(h, i) for i in range(FILTER_HASHES)])
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["cell", "bit"])

    cells = frequent.select("key").mapInArrow(bits, "cell long, bit long").groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(1 << (FILTER_BITS - 6), dtype=np.uint64)
    words[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy().view(np.uint64)
    return frequent.sparkSession.sparkContext.broadcast(words.astype("<u8").view(np.uint8))


class Sums:
    """Counts by hash, added up in sorted arrays."""

    def __init__(self) -> None:
        self.key, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, h: np.ndarray) -> None:
        key, n = np.unique(h, return_counts=True)
        both = np.concatenate([self.key, key])
        order = np.argsort(both, kind="stable")
        both, counts = both[order], np.concatenate([self.n, n])[order]
        first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]]) if len(both) else np.zeros(0, int)
        self.key, self.n = both[first], np.add.reduceat(counts, first) if len(first) else counts


def in_parts(names: list[str], *columns: pa.Array) -> Iterator[pa.RecordBatch]:
    """Columns as batches of at most SENT rows, so that neither side holds all that a task has counted as one batch."""
    for at in range(0, len(columns[0]), SENT):
        yield pa.RecordBatch.from_arrays([c.slice(at, SENT) for c in columns], names=names)


def word_counts(docs: DataFrame) -> DataFrame:
    """``lang, key, n``: words by hash with a null language, and the number of all words of each language."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, totals = Sums(), {}

        def sent() -> Iterator[pa.RecordBatch]:
            names = ["lang", "key", "n"]
            yield from in_parts(names, pa.array(list(totals), pa.string()), pa.array(np.zeros(len(totals), np.int64)), pa.array(list(totals.values()), pa.int64()))
            yield from in_parts(names, pa.nulls(len(sums.key), pa.string()), pa.array(sums.key.view(np.int64)), pa.array(sums.n))

        for words in blocks(batches):
            for i, n in enumerate(np.bincount(words.lang, minlength=len(words.names))):
                totals[words.names[i]] = totals.get(words.names[i], 0) + int(n)
            sums.add(words.word)
            if len(sums.key) > HELD:
                yield from sent()
                sums, totals = Sums(), {}
        yield from sent()

    return docs.mapInArrow(scan, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


def phrase_counts(docs: DataFrame, k: int, known: Broadcast) -> DataFrame:
    """``key, n``: phrases of ``k`` words by hash, where the filter has both parts of ``k`` - 1 words."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()
        sent = lambda: in_parts(["key", "n"], pa.array(sums.key.view(np.int64)), pa.array(sums.n))
        for words in blocks(batches):
            ok = passes(known.value, words.phrases(k - 1))
            sums.add(words.phrases(k)[ok[:-1] & ok[1:] & words.whole(k)] if len(words.word) >= k else np.zeros(0, np.uint64))
            if len(sums.key) > HELD:
                yield from sent()
                sums = Sums()
        yield from sent()

    return docs.mapInArrow(scan, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def stripes(docs: DataFrame, known: list[Broadcast]) -> DataFrame:
    """``lang, prefix, next, counts``: a task's stripes of all phrases that the filters have, by number of words; a word alone has the empty prefix."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Sums] = [Sums() for _ in known]
        said: list[dict[int, str]] = [{} for _ in known]

        def sent() -> Iterator[pa.RecordBatch]:
            for sums, names in zip(held, said, strict=True):
                for at in range(0, len(sums.key), SENT):
                    rows: dict[tuple[str, str], tuple[list, list]] = {}
                    for h, n in zip(sums.key[at : at + SENT].tolist(), sums.n[at : at + SENT].tolist(), strict=True):
                        lang, _, phrase = names[h].rpartition("\n")
                        prefix, _, word = phrase.rpartition(" ")
                        cells = rows.setdefault((lang, prefix), ([], []))
                        cells[0].append(word)
                        cells[1].append(n)
                    cols = [k[0] for k in rows], [k[1] for k in rows], [v[0] for v in rows.values()], [v[1] for v in rows.values()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64())), strict=True)], names=["lang", "prefix", "next", "counts"])

        for words in blocks(batches):
            for k, (sums, names) in enumerate(zip(held, said, strict=True), 1):
                at = np.flatnonzero(words.whole(k))
                at = at[passes(known[k - 1].value, words.phrases(k)[at])]
                h = words.phrases(k)[at]
                new, first = np.unique(h, return_index=True)
                fresh = ~np.isin(new, sums.key)
                for key, i in zip(new[fresh].tolist(), at[first[fresh]].tolist(), strict=True):
                    names[key] = words.names[words.lang[i]] + "\n" + " ".join([words.text(j) for j in range(i, i + k)])
                sums.add(h)
            if sum(map(len, said)) > min(NAMED, HELD * 2):
                yield from sent()
                held, said = [Sums() for _ in known], [{} for _ in known]
        yield from sent()

    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, docs.rdd.getNumPartitions() // STRIPE_PARTS)
    return docs.coalesce(tasks).mapInArrow(scan, "lang string, prefix string, next array<string>, counts array<long>")


def merged(rows: DataFrame) -> DataFrame:
    """Stripes added up cell by cell: ``lang, prefix, next, a``."""
    cells = rows.select("lang", "prefix", F.explode(F.arrays_zip("next", "counts")).alias("c")).select("lang", "prefix", "c.next", "c.counts")
    return cells.groupBy("lang", "prefix", "next").agg(F.sum("counts").alias("a"))


def phrase_table(docs: DataFrame, least: int = 100, longest: int = 5) -> tuple[DataFrame, DataFrame]:
    """All phrases of up to ``longest`` words with at least ``least`` occurrences, as ``lang, phrase, words, a``, and ``lang, n``, the words of each language."""
    rows = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), F.col("text").alias("text"))
    words = stored(word_counts(rows).where((F.col("n") >= least) | F.col("lang").isNotNull()))
    known = [filter_of(words.where("lang is null"))]
    for k in range(2, longest + 1):
        known.append(filter_of(phrase_counts(rows, k, known[-1]).where(F.col("n") >= least)))
    phrase = F.when(F.col("prefix") == "", F.col("next")).otherwise(F.concat_ws(" ", "prefix", "next"))
    found = merged(stripes(rows, known)).where(F.col("a") >= least).withColumn("phrase", phrase)
    table = stored(found.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("words"), "a"))
    return table, words.where("lang is not null").select("lang", "n")


def score_of(l: Column, r: Column) -> Column:
    """floor(1000 * a * n / (l * r)) in decimals of 38 digits."""
    d = lambda c, digits: c.cast(f"decimal({digits},0)")
    above = (F.lit(1000).cast("decimal(4,0)") * d(F.col("a"), 17)).cast("decimal(21,0)") * d(F.col("n"), 16)
    return F.call_function("div", above.cast("decimal(38,0)"), (d(l, 19) * d(r, 18)).cast("decimal(38,0)"))


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, subsumed: int = 100) -> DataFrame:
    """First ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Candidates have 2 to ``longest`` words and a >= ``least`` occurrences. A cut after the first k words has l and r
    occurrences of its parts and the score floor(1000 * a * n / (l * r)), n being all words of the language; the lowest
    cut counts, of equal ones the one with the smallest k. A candidate within a longer one that has at least
    ``subsumed`` percent of its occurrences is dropped: then an extension by one word has that many too, so only these
    are looked at. Order: score falling, a falling, phrase by UTF-8 bytes.

    Null texts are empty, null languages ``und``. Repeated rows count each time. Texts of any length are taken whole.
    Other columns are not looked at. Tables without a frequent phrase, or empty ones, give no rows.
    """
    table, sizes = phrase_table(docs, least, longest)
    words = F.split("phrase", " ")
    joined = lambda first, n: F.array_join(F.slice(words, first, n), " ")
    sub = F.explode(F.array(joined(F.lit(1), F.col("words") - 1), joined(F.lit(2), F.col("words") - 1)))
    extended = table.where("words > 2").select("lang", sub.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("extension"))
    kept = table.where("words > 1").join(extended, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("extension") < subsumed * F.col("a"), F.lit(True)))

    sides = F.explode(F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.struct(k.alias("k"), joined(F.lit(1), k).alias("left"), joined(k + 1, F.col("words") - k).alias("right"))))
    cuts = kept.select("lang", "phrase", "a", sides.alias("c")).select("lang", "phrase", "a", "c.k", F.explode(F.array(F.struct(F.lit("l").alias("side"), F.col("c.left").alias("part")), F.struct(F.lit("r").alias("side"), F.col("c.right").alias("part")))).alias("s"))
    counted = cuts.select("lang", "phrase", "a", "k", "s.side", "s.part").join(table.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")), ["lang", "part"])
    of = lambda side, k: F.max(F.when((F.col("side") == side) & (F.col("k") == k), F.col("f"))).alias(f"{side}{k}")
    scored = counted.groupBy("lang", "phrase").agg(F.max("a").alias("a"), *[of(side, k) for side in "lr" for k in range(1, longest)]).join(sizes, "lang")
    scores = [F.when(F.col(f"l{k}").isNotNull(), F.struct(score_of(F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, longest)]
    lowest = scored.select("lang", "phrase", "a", "n", F.array_min(F.array(*scores)).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score")
    first = top_k(lowest, ["lang"], ["-score", "-a", "phrase"], top)
    return first.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
n AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
o AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM p),
g AS (
  SELECT lang, k, list_slice(w, i, i + k - 1) AS ws, count(*) AS a
  FROM o, generate_series(1, 5) AS t(k) WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100),
x AS (
  SELECT lang, ws, max(a) AS a FROM (
    SELECT lang, list_slice(ws, 1, k - 1) AS ws, a FROM g WHERE k > 2 UNION ALL SELECT lang, list_slice(ws, 2, k) AS ws, a FROM g WHERE k > 2) GROUP BY ALL),
c AS (
  SELECT g.lang, g.ws, g.a, unnest(generate_series(1, g.k - 1)) AS cut, g.k
  FROM g LEFT JOIN x ON g.lang = x.lang AND g.ws = x.ws WHERE g.k > 1 AND (x.a IS NULL OR x.a < g.a)),
s AS (
  SELECT c.lang, array_to_string(c.ws, ' ') AS phrase, c.a, l.a AS l, r.a AS r, n.n, cut,
         (CAST(1000 AS HUGEINT) * c.a * n.n) // (CAST(l.a AS HUGEINT) * r.a) AS score
  FROM c JOIN g l ON l.lang = c.lang AND l.ws = list_slice(c.ws, 1, cut) JOIN g r ON r.lang = c.lang AND r.ws = list_slice(c.ws, cut + 1, c.k) JOIN n ON n.lang = c.lang
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.ws ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM s QUALIFY rank <= 2000
"""
