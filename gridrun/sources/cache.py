"""Tables computed once and reused: named by what they were made from."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridrun.session import shared_folder


def content_key(inputs: dict[str, DataFrame], params: dict) -> str:
    """Hash of parameters, schemas and rows of the inputs, whatever the order or partitioning of the rows.

    One aggregate per input: its number of rows, and the exclusive or and the sum of their 64-bit hashes.
    """
    parts: list = [sorted(params.items())]
    for name, df in sorted(inputs.items()):
        h = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)])
        r = df.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s")).first()
        parts.append((name, sorted(df.dtypes), r.n, r.x, str(r.s)))
    return hashlib.sha256(json.dumps(parts, default=str).encode()).hexdigest()[:32]


def _complete(spark: SparkSession, path: str) -> bool:
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def cached(spark: SparkSession, name: str, inputs: dict[str, DataFrame], params: dict, build: Callable[[], DataFrame], folder: str | None = None) -> DataFrame:
    """The table that ``build`` makes from ``inputs`` and ``params``, from storage if it was completed before.

    Changed rows, columns or parameters give another name, so a stored table is never stale. A table whose write broke
    off has no ``_SUCCESS`` and is built anew. ``folder`` is where tables live beyond the session; the shared folder of
    the session by default.
    """
    path = f"{folder or shared_folder(spark)}/{name}-{content_key(inputs, params)}"
    if not _complete(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
