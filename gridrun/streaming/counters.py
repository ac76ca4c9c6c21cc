"""Running accuracy counters over scored tiles as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridrun.sources.sinks import scratch_path


def stream_confusion(spark: SparkSession, folder: str, schema: str, name: str, files_per_batch: int = 2) -> DataFrame:
    """Read scored pixels ``(gt, pred)`` file by file and keep the confusion counts.

    The state is one row per (gt, pred) cell, so it never grows with the input.
    Complete mode writes the whole, tiny table; returns the final one.
    """
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    counts = src.groupBy("gt", "pred").agg(F.count("*").alias("n"))
    q = (counts.writeStream.outputMode("complete").format("memory").queryName(name)
         .option("checkpointLocation", scratch_path(spark, "stream")).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.table(name)
