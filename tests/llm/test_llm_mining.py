"""URL filters, hard negatives and collocations."""

import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridrun.llm import collocations, negatives, urls


def plain_url(url):
    """Host, path and longest rule of a URL, by hand."""
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, default=None)


PAGES = "page_id long, url string"


def check_urls(rows, got):
    want = sorted((page, *plain_url(url)) for page, url in rows) if all(p is not None for p, _ in rows) else None
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    for page, url in rows:
        host, path, rule = plain_url(url)
        mine = [r for r in by[page] if (r.host, r.path) == (host, path)]
        assert mine and all(r.verdict in ("allow", "block") for r in mine)
        for r in mine:
            assert r.rule == (rule and rule[1]) and (rule is None or r.verdict == rule[2]) and (r.score is None) == (rule is not None)
    return want


def test_urls_against_plain_rules(spark):
    hosts = ["org", "a.org", "example.org", "x.example.org", "notexample.org", "EXAMPLE.Org", "com", "b.COM", "xcom", "net", "org:80", "ÀÖ.org", ""]
    tails = ["", "/", "/es/", "/es", "/en/1", "/en/12/x.html", "/en/2", "/fr/a?u=http://x.org/es/", "/de/#top", "?/fr/", "#/de/", "/a/b/c?x=1&y=2#z", "/de/\nx"]
    rows = [(i, f"{s}{h}{t}") for i, (s, h, t) in enumerate((s, h, t) for s in ("http://", "https://", "a://b://", "") for h in hosts for t in tails)]
    rows += [(-1, None), (-2, ""), (-3, "://"), (-4, "http://a.org/" + "x%20/" * 50_000), (-5, "no scheme.org/fr/")]
    check_urls(rows, urls.filter_urls(spark.createDataFrame(rows, PAGES).repartition(3).withColumn("host", F.lit(1)).withColumn("blocked", F.lit(2)).withColumn("_label", F.lit(3))).collect())


def test_urls_whole_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = [(r.page_id, r.url) for r in pages.select("page_id", "url").collect()]
    got = urls.filter_urls(pages).collect()
    check_urls(rows, got)
    again = urls.filter_urls(pages.repartition(7)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_urls_learn_from_labels(spark):
    """Held-out accuracy on URLs of two habits, neither of which a rule names."""
    rng = random.Random(5)
    rows = []
    for i in range(1200):
        bad = rng.random() < 0.4
        word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
        url = f"http://{word(5)}{rng.randrange(10**6)}.biz/{'/'.join(word(3) for _ in range(rng.randrange(4, 8)))}?{'&'.join(f'{word(2)}={rng.randrange(10**9)}' for _ in range(rng.randrange(3, 6)))}" if bad else f"https://{word(6)}.net/{word(8)}"
        rows.append((i, url, bad))
    table = urls.split_urls(spark.createDataFrame([r[:2] for r in rows], PAGES)).join(spark.createDataFrame([(r[0], r[2]) for r in rows], "page_id long, blocked boolean"), "page_id")
    held = F.crc32(F.col("page_id").cast("string").cast("binary")) % 4 == 2
    model = urls.train(table.where(~held))
    got = {r.page_id: r.judged == "block" for r in model.predict(table.where(held)).collect()}
    assert set(got) == {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(got[i] == bad for i, _, bad in rows if i in got) / len(got) > 0.95


def test_urls_awkward(spark):
    rows = [(1, "http://a.net/x"), (1, "http://a.net/x"), (None, "http://b.net"), (2, None), (None, None)]
    for extra, verdict in (([], "allow"), ([(9, "http://a.com/de/x")], "block"), ([(9, "http://a.org/")], "allow")):
        got = urls.filter_urls(spark.createDataFrame(rows + extra, PAGES)).collect()
        assert len(got) == len(rows + extra) and {r.verdict for r in got if r.rule is None} == {verdict}
    empty = urls.filter_urls(spark.createDataFrame([], PAGES))
    assert empty.count() == 0 and empty.columns[:5] == ["page_id", "host", "path", "rule", "verdict"]


def plain_negatives(rows, is_anchor, positives=5, negatives=3):
    """All scores of all anchors; ``rows`` maps vec_id to (label, integers)."""
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for anchor, (label, q) in rows.items():
        if is_anchor(anchor):
            scored = sorted((-dot(q, v), i, k == label) for i, (k, v) in rows.items() if i != anchor)
            for s, pos, _ in [x for x in scored if x[2]][:positives]:
                fits = [(i, -n) for n, i, same in scored if not same and 50 * -s <= 100 * -n <= 95 * -s][:negatives]
                out += [(anchor, pos, r, i, -s, n) for r, (i, n) in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows, is_anchor):
    table = spark.createDataFrame([(i, k, [float(x) for x in q]) for i, (k, q) in rows.items()], "vec_id long, label int, q array<double>").repartition(3)
    return sorted(tuple(r) for r in negatives.mine(table, is_anchor).collect())


def test_negatives_against_all_scores(spark, monkeypatch):
    """Small segments and cells, so that walks end early, cross segments and cells, and meet ties at every border."""
    for name, value in (("LEAST_SEGMENT", 40), ("CELL_MEMBERS", 4), ("CELL_CANDIDATES", 16), ("STEP", 5), ("ANCHORS_PER_CLUSTER", 3)):
        monkeypatch.setattr(negatives, name, value)
    rng = random.Random(3)
    for span, dims in ((2, 3), (40, 6), (300_000_000, 5)):
        rows = {i - 60: (rng.randrange(4), [rng.randint(-span, span) for _ in range(dims)]) for i in range(260)}
        rows |= {1000 + i: (i % 3, [span, *[0] * (dims - 1)]) for i in range(40)}
        rows[2000], rows[2001], rows[2002] = (1, [0] * dims), (0, [span]), (7, [span] * dims)
        assert mined(spark, rows, F.col("vec_id") % 5 == 0) == plain_negatives(rows, lambda i: i % 5 == 0)


def test_negatives_whole_table(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = {r.vec_id: ((r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, [int(256 * x // 1) for x in r.embedding]) for r in table.collect()}
    assert sorted(tuple(r) for r in negatives.hard_negatives(table).collect()) == plain_negatives(rows, lambda i: i % 50 == 0)


def test_negatives_awkward(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(100, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 2, [0.9, 0.1]), (3, 2, [nan, 1.0]), (4, 2, [inf, 1.0]), (5, 2, [None, 1.0]), (6, None, [0.9, 0.0]), (7, 0, None), (None, 2, [0.9, 0.0]), (8, 2, []), (50, 5, [1.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("q", F.lit("x")).withColumn("norm", F.lit(0))
    assert [tuple(r) for r in negatives.hard_negatives(table).collect()] == [(100, 1, 1, 2, 65536, 58880)]
    for none in (table.limit(0), table.where("vec_id = 3"), table.where("vec_id = 2"), table.where("vec_id = 50")):
        assert negatives.hard_negatives(none).count() == 0


def plain_collocations(rows, least, top, longest=5):
    words, counts = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            counts.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    found = {}
    candidates = {(lang, w): a for (lang, w), a in counts.items() if len(w) > 1 and a >= least}
    gone = {(lang, w[i:j]) for (lang, w), a in candidates.items() for i in range(len(w)) for j in range(i + 2, len(w) + 1) if j - i < len(w) and 100 * a >= 100 * counts[lang, w[i:j]]}
    for (lang, w), a in candidates.items():
        if (lang, w) not in gone:
            score, _, left, right = min((1000 * a * words[lang] // (counts[lang, w[:k]] * counts[lang, w[k:]]), k, counts[lang, w[:k]], counts[lang, w[k:]]) for k in range(1, len(w)))
            found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, r, p.decode(), -a, left, right, words[lang], -s) for lang, x in found.items() for r, (s, a, p, left, right) in enumerate(sorted(x)[:top], 1))


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(8)
    vocabulary = ["a", "b", "É", "é", "cc", "D", "the", "of", "x1", "日本", "\u00a0", "z" * 300]
    return [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(vocabulary[: rng.randrange(3, 13)]) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", " \x0b"]) for _ in range(rng.randrange(0, 60)))) for _ in range(150)]


def test_collocations_against_counting(spark, docs_of, prose, monkeypatch):
    rows = [(i, text, lang) for i, (lang, text) in enumerate(prose)]
    for block, held in ((collocations.BLOCK, collocations.HELD), (64, 20)):
        monkeypatch.setattr(collocations, "BLOCK", block)
        monkeypatch.setattr(collocations, "HELD", held)
        for least, top in ((3, 2000), (12, 4)):
            assert sorted(tuple(r) for r in collocations.collocations(docs_of(rows), least=least, top=top).collect()) == plain_collocations(prose, least, top)


def test_collocations_survive_a_full_filter(docs_of, prose, monkeypatch):
    """A filter that lets everything through changes no result."""
    monkeypatch.setattr(collocations, "passes", lambda known, h: h == h)
    rows = [(i, text, lang) for i, (lang, text) in enumerate(prose)]
    assert sorted(tuple(r) for r in collocations.collocations(docs_of(rows), least=5).collect()) == plain_collocations(prose, 5, 2000)


def test_counts_leave_a_task_in_small_batches(monkeypatch):
    """A task's counts went out as one batch, which JVM and worker both held whole."""
    monkeypatch.setattr(collocations, "SENT", 3)
    parts = list(collocations.in_parts(["key", "n"], pa.array(range(8)), pa.array(range(8, 16))))
    assert [b.num_rows for b in parts] == [3, 3, 2]
    assert pa.Table.from_batches(parts).to_pydict() == {"key": [*range(8)], "n": [*range(8, 16)]}


def test_collocations_awkward(awkward, nothing):
    rows = [(r.lang, r.text) for r in awkward.collect()]
    table = awkward.withColumn("n", F.lit("x")).withColumn("phrase", F.lit(1)).withColumn("words", F.lit(2))
    assert sorted(tuple(r) for r in collocations.collocations(table, least=2).collect()) == plain_collocations(rows, 2, 2000)
    assert collocations.collocations(awkward).count() == 0 and collocations.collocations(nothing).count() == 0
