"""A corpus pipeline of five stages over ``documents``; each stage's rows are written and read again by the next.

1. quality rules: documents that the repetition rules reject go
2. n-gram Jaccard join: of every group of copies and near copies the document with the least doc_id stays
3. benchmark decontamination: documents that overlap a benchmark item go
4. secret scans: secrets, encoded ones too, are replaced in the text
5. mixing: whole and partial repetitions of the documents by source weight; documents of which nothing is taken go
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridrun.llm import decontaminate, jaccard, mixing, repetition, secrets
from gridrun.llm.common import table
from gridrun.session import shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repetition.keep_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one_per_class(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Columns of op8 and of the documents, for the documents that the mix takes."""
    carried = [c for c in docs.columns if c not in ("doc_id", "size", "source_size", "target", "taken")]
    return mixing.mix_sources(docs, carry=carried).where(F.col("taken") > 0)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", mix),
]

#: Near-duplicate classes and decoding to a fixpoint can't be put in SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; intermediate rows go to the folder of spark.checkpoint.dir."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
