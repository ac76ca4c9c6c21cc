"""Operators across texts: near duplicates, paragraphs, substrings, benchmark overlaps."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridrun.llm import decontaminate, jaccard, minhash, paragraphs, queries, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(rng, n):
    return [f"{rng.choice('bcdfgklmnprst')}{rng.randrange(5000)}" for _ in range(n)]


def shingles(text):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + min(5, len(w))]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_classes(rows):
    """doc_id to (class_id, n_links), all pairs."""
    texts = {}
    for d, t in rows:
        if shingles(t):
            texts[t] = min(texts.get(t, d), d)
    sets = {t: shingles(t) for t in texts}
    parent, links = {t: t for t in texts}, collections.Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    names = list(texts)
    for i, a in enumerate(names):
        for b in names[:i]:
            common = len(sets[a] & sets[b])
            if common >= 0.8 * (len(sets[a]) + len(sets[b]) - common) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                if texts[x] > texts[y]:
                    x, y = y, x
                parent[y] = x
    return {d: (texts[find(t)], links[t]) if t in texts else (d, 0) for d, t in rows}


@pytest.fixture(scope="module")
def near_rows():
    rng = random.Random(5)
    rows = []
    for _ in range(25):
        base = words(rng, rng.randrange(4, 150))
        for _ in range(rng.choice([1, 1, 2, 4, 9])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = "changed"
            rows.append(" ".join(copy))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_classes_against_all_pairs(docs_of, near_rows):
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.classes(docs_of(near_rows).withColumn("u", F.lit("x"))).collect()}
    assert got == brute_classes(near_rows)


def test_large_group_in_blocks(docs_of, monkeypatch):
    monkeypatch.setattr(jaccard.verified, "__defaults__", (0.8, 5, 16))
    rng = random.Random(9)
    base = words(rng, 60)
    rows = [(i, " ".join(base[: i % 60] + [f"z{i}"] + base[i % 60 + 1 :])) for i in range(70)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.classes(docs_of(rows)).collect()}
    assert got == brute_classes(rows)


def test_whole_table_keeps_every_link(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: (r.class_id, r.n_links) for r in queries.op10_ngram_jaccard(spark, sf).collect()}
    assert got == brute_classes(rows)


def test_classes_awkward(awkward, nothing):
    rows = jaccard.classes(awkward).collect()
    assert len(rows) == 10 and {(r.doc_id, r.class_id, r.n_copies) for r in rows if r.doc_id == 5} == {(5, 5, 2)}
    assert jaccard.classes(nothing).count() == 0
    kept = jaccard.keep_one_per_class(awkward)
    assert kept.columns == awkward.columns and kept.count() == 9  # the repeated row once


def test_bands_reach_the_recall():
    for rows in (1, 2, 3, 4):
        n = minhash.bands_for(0.8, 0.9999, rows)
        assert 1 - (1 - 0.8**rows) ** n >= 0.9999 > 1 - (1 - 0.8**rows) ** (n - 1)


def test_components_of_long_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 100)] + [(7, 7)]
    got = {r.id: r.label for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(100)}}


def brute_substrings(rows, n=50):
    seen, out = {}, {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - n + 1):
            seen[b[i : i + n]] = min(seen.get(b[i : i + n], d), d)
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] < d:
                gone[i : i + n] = b"\1" * n
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[d] = (len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def test_a_common_line_is_spread(docs_of, monkeypatch):
    """A line in many documents with other surroundings: right with hot names, and no name holds a row per document."""
    monkeypatch.setattr(substrings, "HOT", 20)
    rng = random.Random(13)
    line = "".join(rng.choice("abcdefgh ") for _ in range(140))
    noise = lambda: "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(30, 90)))
    rows = [(d, noise() + line + noise()) for d in range(400)] + [(1000 + d, line[: 60 + d] + noise()) for d in range(60)]
    rows += [(2000 + d, noise() + "la lo " * (40 + d)) for d in range(60)]
    docs = docs_of(rows)
    got = {r.doc_id: tuple(r)[1:5] for r in substrings.dedup_substrings(docs).collect()}
    assert got == brute_substrings(rows)
    bits = substrings._bits_for(docs)
    names = substrings.shared_names(docs, 50, bits).groupBy("doc_id").agg(F.collect_set("name").alias("names"))
    sent = substrings.sent_starts(docs, names, 50, bits).where("payload IS NOT NULL")
    assert sent.groupBy("name").count().agg(F.max("count")).first()[0] <= 20


@pytest.mark.parametrize("slice_chars", [300, 4_000_000])
def test_substrings_against_brute_force(docs_of, slice_chars, monkeypatch):
    rng = random.Random(11)
    shared = ["".join(rng.choice("abcé ") for _ in range(rng.randrange(20, 200))) for _ in range(12)]
    rows = []
    for d in range(60):
        parts = [rng.choice(shared) if rng.random() < 0.5 else "".join(rng.choice("abcé ") for _ in range(rng.randrange(90))) for _ in range(rng.randrange(4))]
        rows.append((d, "".join(parts)))
    rows += [(100, "a" * 500), (101, "a" * 70), (102, "ab" * 200), (103, "ba" * 40), (104, None), (105, ""), (106, "x" * 49), (107, "x" * 49)]
    monkeypatch.setattr("gridrun.llm.common.SLICE_CHARS", slice_chars)
    rng.shuffle(rows)
    got = {r.doc_id: tuple(r)[1:5] for r in substrings.dedup_substrings(docs_of(rows)).collect()}
    assert got == brute_substrings(rows)


def test_substrings_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in queries.op9_suffix_dedup(spark, sf).collect()}
    assert got == brute_substrings(rows)


def test_substrings_awkward(awkward, nothing):
    rows = substrings.dedup_substrings(awkward.withColumn("kept", F.lit(1))).collect()
    assert len(rows) == 10 and all(r.n_removed == 0 and len(r.kept) == r.n_bytes for r in rows)
    assert substrings.dedup_substrings(nothing).count() == 0


def test_half_ranks_name_equal_strings():
    data = np.frombuffer(b"abcabcabcabcabcabcabcabcabcabcabcabcabcabcabcabc", dtype=np.uint8)
    ranks = substrings.half_ranks(data, 25)
    assert len(ranks) == len(data) - 24 and len(set(ranks.tolist())) == 3 and ranks[0] == ranks[3] != ranks[1]


def test_paragraphs(docs_of):
    rng = random.Random(2)
    line, other, passage = " ".join(words(rng, 40)), " ".join(words(rng, 30)), " ".join(words(rng, 60))
    near = line.split(" ")
    near[20] = "changed"
    mid = lambda: f"{' '.join(words(rng, 25))} {passage} {' '.join(words(rng, 25))}"
    first, second = mid(), mid()
    rows = {r.doc_id: r for r in paragraphs.dedup_paragraphs(docs_of([(1, f"{line}\n{other}"), (2, f"short\n{' '.join(near)}\nend"), (3, f"{other}\nown words here"), (4, first), (5, second), (6, " ".join(words(rng, 70))), (7, "short\nend")]), threshold=0.7).collect()}
    assert rows[1].text == f"{line}\n{other}" and rows[6].n_removed_words == rows[7].n_removed_words == 0
    assert rows[2].text == "short\nend" and list(rows[2].first_docs) == [1]
    assert rows[3].text == "own words here" and rows[3].n_removed_lines == 1
    assert rows[4].text == first and list(rows[5].first_docs) == [4] and rows[5].n_removed_words >= 20
    assert all(w in second for w in WORD.findall(rows[5].text)) and not set(passage.split(" ")) & set(WORD.findall(rows[4].text)) == set()


def test_passages_of_window_words_are_never_missed(docs_of):
    rng = random.Random(4)
    for _ in range(20):
        passage = words(rng, 50)
        a, b = (set(paragraphs.slice_marks(["x y", " ".join(words(rng, rng.randrange(40)) + passage + words(rng, rng.randrange(40)))], 50, 20)[2].tolist()) for _ in range(2))
        assert a & b


def brute_runs(rows, window):
    """doc_id to the words that stay when every stretch that a smaller document has goes."""
    seen, out = {}, {}
    for d, t in rows:
        w = WORD.findall(t or "")
        for i in range(len(w) - window + 1):
            seen[tuple(w[i : i + window])] = min(seen.get(tuple(w[i : i + window]), d), d)
    for d, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        out[d] = [x for x, g in zip(w, gone, strict=True) if not g]
    return out


def test_passages_go_whole_and_over_line_ends(docs_of):
    rng = random.Random(6)
    passage = words(rng, 50)
    around = lambda p, sep: "\n".join([" ".join(words(rng, 9)), sep.join(p), " ".join(words(rng, 9))])
    verse = "\n".join(" ".join(passage[i : i + 6]) for i in range(0, 50, 6))
    rows = [(1, around(passage, " ")), (2, around(passage, " ")), (3, around([verse], " ")), (4, around(passage[:49], " "))]
    got = {r.doc_id: r for r in paragraphs.dedup_paragraphs(docs_of(rows), min_words=1000).collect()}
    assert [got[d].n_removed_words for d in (1, 2, 3, 4)] == [0, 50, 50, 0]
    assert {d: WORD.findall(got[d].text) for d in got} == brute_runs(rows, 50) and list(got[3].first_docs) == [1]


@pytest.mark.parametrize("window, shingle", [(13, 5), (50, 20)])
def test_passages_against_brute_force(docs_of, window, shingle):
    rng = random.Random(12)
    shared = [words(rng, rng.randrange(window // 2, 4 * window)) for _ in range(10)]
    rows = []
    for d in range(60):
        parts = []
        for _ in range(rng.randrange(5)):
            p = rng.choice(shared) if rng.random() < 0.6 else words(rng, rng.randrange(30))
            a = rng.randrange(len(p) // 2 + 1)
            parts += p[a : rng.randrange(a, len(p) + 1)] if rng.random() < 0.5 else p
        rows.append((d, "".join(w + rng.choice("  \n") for w in parts)))
    rows += [(100, "la " * 200), (101, "la\n" * 90), (102, "la lo " * 100), (103, "lo la " * 30), (104, None), (105, "")]
    got = {r.doc_id: WORD.findall(r.text or "") for r in paragraphs.dedup_paragraphs(docs_of(rows), min_words=1000, window=window, shingle=shingle).collect()}
    assert got == brute_runs(rows, window)


def test_paragraphs_whole_table_lines(spark, sf):
    """Lines that go, against all pairs of distinct lines."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lines = [((r.doc_id, i), x) for r in docs.collect() for i, x in enumerate((r.text or "").split("\n")) if len(WORD.findall(x)) >= 10]
    sets, first, index = {}, {}, collections.defaultdict(list)
    for place, x in sorted(lines):
        if x not in sets:
            sets[x] = shingles(x)
            for g in sets[x]:
                index[g].append(x)
        first.setdefault(x, place)
    parent = {x: x for x in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    counts = collections.Counter((a, b) for xs in index.values() for i, a in enumerate(xs) for b in xs[:i])
    for (a, b), c in counts.items():
        if c >= 0.8 * (len(sets[a]) + len(sets[b]) - c) - 1e-9:
            a, b = sorted((find(a), find(b)), key=first.get)
            parent[b] = a
    want = {p for p, x in lines if p != first[find(x)]}
    got = {(r.doc_id, r.line) for r in paragraphs.repeated_lines(docs).collect()}
    assert got == want


def test_paragraphs_awkward(awkward, nothing):
    rows = paragraphs.dedup_paragraphs(awkward.withColumn("line", F.lit(1))).collect()
    assert len(rows) == 10 and sum(r.text is None for r in rows) == 2
    assert paragraphs.dedup_paragraphs(nothing).count() == 0


def brute_overlaps(docs, items, window=13):
    tokens = lambda t: re.findall(r"\w+", (t or "").lower())
    out = set()
    for d, t in docs:
        a = tokens(t)
        for k, u in items:
            b = tokens(u)
            w = min(window, len(b))
            if len(b) < 3:
                continue
            for i in range(len(a) - w + 1):
                if any(sum(x == y for x, y in zip(a[i : i + w], b[j : j + w], strict=True)) >= 0.8 * w - 1e-9 for j in range(len(b) - w + 1)):
                    out.add((d, k))
                    break
    return out


def test_decontamination(docs_of, spark):
    rng = random.Random(8)
    items = [(1, " ".join(words(rng, 30))), (2, " ".join(words(rng, 12))), (3, "four short tokens here"), (4, "no"), (5, None), (6, "")]
    one, two = items[0][1].split(" "), items[1][1].split(" ")
    swapped = [("subst" if i in (4, 17) else w) for i, w in enumerate(one)]
    part = one[8:22]
    docs = [(1, " ".join(words(rng, 30) + one + words(rng, 9))), (2, " ".join(words(rng, 5) + swapped)), (3, " ".join(part)), (4, " ".join(words(rng, 200))), (5, " ".join(one[:7])), (6, "X " + items[1][1].upper() + " y"), (7, "say FOUR short tokens, here!"), (8, "no no no"), (9, " ".join([*two[:3], "subst", *two[4:]]))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs_of(docs).withColumn("pos", F.lit(1)), benchmark.withColumn("seed", F.lit(1))).collect()}
    assert got == brute_overlaps(docs, items) == {(1, 1), (2, 1), (3, 1), (6, 2), (7, 3), (9, 2)}
    kept = decontaminate.drop_contaminated(docs_of(docs), benchmark)
    assert kept.columns == docs_of(docs).columns and {r.doc_id for r in kept.collect()} == {4, 5, 8}


def test_decontamination_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    exact = {(d, k) for d, t in docs for k, u in items if " ".join(re.findall(r"\w+", u.lower())) in " ".join(re.findall(r"\w+", (t or "").lower()))}
    got = {(r.doc_id, r.item_id) for r in queries.op4_decontamination(spark, sf).collect()}
    assert exact <= got and all(any(d == x for x, _ in exact) for d, _ in got)


def test_decontamination_awkward(awkward, nothing, spark):
    benchmark = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.overlaps(awkward, benchmark).collect()] == [(5, 1)]
    assert decontaminate.overlaps(nothing, benchmark).count() == 0
    assert decontaminate.drop_contaminated(awkward, benchmark.limit(0)).count() == 10
