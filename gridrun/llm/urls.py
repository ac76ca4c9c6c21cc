"""URL filters: host and path rules first, gradient-boosted trees on lexical features where no rule speaks.

The URLs that a rule judges are the labelled ones. Trees learn from a seeded sample of them (at most about
``train_rows`` rows) and judge all others. Features are column expressions over the URL: lengths, depth, digit ratio,
entropy, parameter counts, and what is known of the URL's suffix (last label of the host) and first directory among
all labelled URLs. DataFrame functions and Spark's own boosted trees only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridrun.llm.common import stored

#: (verdict, host, path): a rule fits its host and all subdomains of it where the URL's path starts with the rule's.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("length", "host_length", "path_length", "labels", "depth", "digit_ratio", "host_digits", "hyphens", "entropy", "parameters", "query_length", "specials", "has_extension", "suffix_block", "suffix_share", "head_block", "head_share")
#: An affix is kept by itself if it holds at least this part of the labelled rows, so a kind of affix has 1 / LEAST_SHARE rows at most.
LEAST_SHARE = 0.001


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty for null or without it."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(after_scheme(url), r"^[^/?#]*+", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*+([^?#]*+)", 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^?#]*+\?([^#]*+)", 1)


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as a struct ``(size, rule, verdict)``; null where none does. Of two that are as long, the later by code point."""
    found = []
    for verdict, at, start in rules:
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(start)
        found.append(F.when(fits, F.struct(F.lit(len(at) + len(start)).alias("size"), F.lit(at + start).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.greatest(*found) if len(found) > 1 else found[0]


def split_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """``page_id, url, host, path, rule, ruled`` (the rule's verdict)."""
    rows = pages.select(F.col("page_id").alias("page_id"), F.col("url").alias("url"))
    rows = rows.select("page_id", "url", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), F.coalesce(path_of(F.col("url")), F.lit("")).alias("path"))
    return rows.withColumn("_best", longest_rule(F.col("host"), F.col("path"), rules)).select("*", F.col("_best.rule").alias("rule"), F.col("_best.verdict").alias("ruled")).drop("_best")


def entropy(text: Column) -> Column:
    """Bits per character over the ASCII characters; all others count as one more."""
    plain = F.regexp_replace(text, r"[^\x00-\x7F]", "\x7f")
    size = F.length(plain).cast("double")

    def part(total: Column, char: Column) -> Column:
        share = (size - F.length(F.replace(plain, char, F.lit("")))) / size
        return total - F.when(share > 0, share * F.log2(share)).otherwise(0.0)

    return F.when(size > 0, F.aggregate(F.array_distinct(F.split(plain, "")), F.lit(0.0), part)).otherwise(0.0)


def lexical(urls: DataFrame) -> DataFrame:
    """Adds the features that need no statistics, and the affixes ``suffix`` and ``head``. A null URL counts as an empty one."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    query = F.coalesce(query_of(url), F.lit(""))
    n = lambda c: c.cast("double")
    return urls.withColumns({
        "length": n(F.length(url)), "host_length": n(F.length(host)), "path_length": n(F.length(path)), "labels": n(F.regexp_count(host, F.lit(r"\."))), "depth": n(F.regexp_count(path, F.lit("/"))),
        "digit_ratio": n(F.regexp_count(url, F.lit("[0-9]"))) / F.greatest(F.length(url), F.lit(1)), "host_digits": n(F.regexp_count(host, F.lit("[0-9]"))), "hyphens": n(F.regexp_count(host, F.lit("-"))), "entropy": entropy(url),
        "parameters": F.when(query == "", 0.0).otherwise(n(F.regexp_count(query, F.lit("&"))) + 1), "query_length": n(F.length(query)), "specials": n(F.regexp_count(url, F.lit("[%@=_~+]"))),
        "has_extension": n(F.regexp_like(path, F.lit(r"\.[A-Za-z0-9]{1,5}\z")).cast("int")), "suffix": F.substring_index(host, ".", -1), "head": F.regexp_extract(path, r"^/([^/]*+)", 1),
    })


def affix_table(labelled: DataFrame, affix: str, total: int) -> DataFrame:
    """``affix, <affix>_block, <affix>_share``: smoothed share of blocked rows and share of all ``total`` labelled rows, over all of them.

    Rare affixes are one row together, under null, and the others are 1 / LEAST_SHARE rows at most.
    """
    counts = labelled.groupBy(affix).agg(F.sum(F.col("blocked").cast("long")).alias("b"), F.count("*").alias("n"))
    kept = counts.groupBy(F.when(F.col("n") >= LEAST_SHARE * total, F.col(affix)).alias(affix)).agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
    return kept.select(affix, ((F.col("b") + 1.0) / (F.col("n") + 2.0)).alias(f"{affix}_block"), (F.col("n") / float(max(total, 1))).alias(f"{affix}_share"))


@dataclass
class UrlModel:
    """Trees with the affix tables, or a constant verdict where the labelled URLs have fewer than two verdicts."""

    trees: GBTClassificationModel | None
    affixes: dict[str, DataFrame]
    constant: str = "allow"

    def features(self, urls: DataFrame) -> DataFrame:
        rows = lexical(urls)
        for affix, known in self.affixes.items():
            rows = rows.join(F.broadcast(known.where(F.col(affix).isNotNull())), affix, "left").fillna({f"{affix}_block": 0.5, f"{affix}_share": 0.0})
        return VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(rows)

    def predict(self, urls: DataFrame) -> DataFrame:
        """``urls`` (with host and path) with ``score``, the chance of block, and ``judged``, allow or block."""
        if self.trees is None:
            return urls.withColumns({"score": F.lit(float(self.constant == "block")), "judged": F.lit(self.constant)})
        scored = self.trees.transform(self.features(urls)).withColumn("score", vector_to_array("_chance")[1])
        return scored.select(*urls.columns, "score", F.when(F.col("score") > 0.5, "block").otherwise("allow").alias("judged"))


def train(labelled: DataFrame, train_rows: int = 16_000, trees: int = 20, depth: int = 4) -> UrlModel:
    """A model from rows of ``url, host, path, blocked`` (boolean).

    Affix statistics run over all rows; the trees see a draw by the URL's hash of about ``train_rows`` of them, in the
    order of the URLs, so that reruns agree. Without rows, or with one verdict only, the model is a constant.
    """
    counts = {r.blocked: r.n for r in labelled.groupBy("blocked").agg(F.count("*").alias("n")).collect()}
    rows = lexical(labelled)
    affixes = {affix: stored(affix_table(rows, affix, sum(counts.values()))) for affix in ("suffix", "head")}
    if len(counts) < 2:
        return UrlModel(None, affixes, "block" if True in counts else "allow")
    model = UrlModel(None, affixes)
    place = F.pmod(F.xxhash64("url"), F.lit(1 << 30)) / float(1 << 30)
    drawn = labelled.where(place < train_rows / sum(counts.values()))
    drawn = stored(model.features(drawn).select("url", F.col("blocked").cast("double").alias("_label"), *FEATURES))
    drawn = VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(drawn.coalesce(1).sortWithinPartitions("url"))
    learner = GBTClassifier(featuresCol="_features", labelCol="_label", predictionCol="_predicted", maxIter=trees, maxDepth=depth, seed=7).setProbabilityCol("_chance").setRawPredictionCol("_raw")
    if drawn.select("_label").distinct().count() < 2:
        return UrlModel(None, affixes, "block" if counts[True] > counts[False] else "allow")
    model.trees = learner.fit(drawn)
    return model


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, train_rows: int = 16_000) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score.

    ``rule`` is the longest rule that fits, as host and path in one, else null; ``verdict`` is its verdict, else that of
    the trees trained on the pages with a rule; ``score`` is the trees' chance of block, null where a rule speaks.
    ``rules`` is a short list: each is an expression over every row. A null URL, or one without ``://``, has an empty
    host and path and is judged by the trees like any other. Repeated rows get a row each, other columns of ``pages``
    are not looked at, and an empty table gives no rows. Without rows of both verdicts to learn from, all rows without
    a rule get the only verdict known, or allow.
    """
    split = split_urls(pages, rules)
    model = train(split.where("ruled is not null").withColumn("blocked", F.col("ruled") == "block"), train_rows)
    rows = model.predict(split)
    none = F.col("ruled").isNull()
    return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", "judged").alias("verdict"), F.when(none, F.col("score")).alias("score"))
