"""Shared helpers of the training-data operators."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  makes pa.compute available
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridrun.session import shared_folder

#: A word: a run of anything but blank, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD)
SLICE_CHARS = 4_000_000
#: For operators that hold several numbers per character, and run after one another in the same workers.
SMALL_SLICE = 1_500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", chars: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Arrow batches cut to about ``chars`` of text (one row at least), with the texts as Python strings (None for null)."""
    for batch in batches:
        sizes = np.asarray(pa.compute.fill_null(pa.compute.utf8_length(batch.column(text).cast(pa.large_string())), 0), dtype=np.int64)
        at, total = 0, 0
        for i, n in enumerate(sizes):
            if i > at and total + n > chars:
                part = batch.slice(at, i - at)
                yield part, part.column(text).to_pylist()
                at, total = i, 0
            total += n
        if batch.num_rows > at:
            part = batch.slice(at)
            yield part, part.column(text).to_pylist()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cut from its lineage, smaller than a checkpoint."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores added until no column of ``df`` has it (names differ in more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
