"""Calibration vectors, asset inventories and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridrun.constants import DEFAULT_BIAS


def calibration_vector(classes: DataFrame, stored: DataFrame, strict: bool = False) -> DataFrame:
    """Stored bias per class, the default where none is stored; ``strict`` raises instead."""
    default = F.element_at(F.array(*[F.lit(b) for b in DEFAULT_BIAS]), F.col("class_id") + 1)
    missing = F.raise_error(F.lit("calibration vector is incomplete")).cast("double") if strict else default
    return classes.select("class_id").join(stored, "class_id", "left").select(
        "class_id", F.coalesce("bias", missing).alias("bias"))


def scan_files(spark, pattern: str | list[str], sources: dict[str, str]) -> DataFrame:
    """Files under the given patterns as (source, path, stem, bytes); contents are not read.

    ``sources`` maps a source name to a path fragment.
    """
    files = spark.read.format("binaryFile").load(pattern).select("path", F.col("length").alias("bytes"))
    tag = F.coalesce(*[F.when(F.col("path").contains(frag), name) for name, frag in sources.items()], F.lit("unknown"))
    return files.select(tag.alias("source"), "path", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("stem"), "bytes").dropDuplicates(["path"])


def load_config(spark, path: str, lines: bool = False) -> dict[str, DataFrame]:
    """JSON configuration -> class dimension and split dimension; with ``lines`` a document per line, each with a part of the splits."""
    doc = spark.read.option("multiLine", not lines).schema(
        "classes array<struct<id:int,name:string,color_rgb:array<int>>>, "
        "splits struct<train_tiffs:array<string>,val_tiffs:array<string>>").json(path)
    c = doc.select(F.explode("classes").alias("c")).distinct()
    classes = c.select(F.col("c.id").alias("class_id"), F.col("c.name").alias("name"), F.col("c.color_rgb")[0].alias("red"),
                       F.col("c.color_rgb")[1].alias("green"), F.col("c.color_rgb")[2].alias("blue"))
    part = lambda name, split: doc.select(F.explode(f"splits.{name}").alias("stem"), F.lit(split).alias("split"))
    return {"classes": classes, "splits": part("train_tiffs", "train").unionByName(part("val_tiffs", "val"))}


def manifest(assets: DataFrame, content: str) -> DataFrame:
    """Path, SHA-256 of the whole content and size per asset."""
    return assets.select("path", F.sha2(F.col(content), 256).alias("sha256"), F.octet_length(content).cast("long").alias("bytes"))


def verify_manifest(listed: DataFrame, actual: DataFrame) -> DataFrame:
    """Every manifest row with its status; hashes compare without case."""
    a = actual.select("path", F.col("sha256").alias("have"))
    return listed.join(a, "path", "left").withColumn(
        "status", F.when(F.col("have").isNull(), "missing").when(F.lower("have") != F.lower("sha256"), "checksum mismatch").otherwise("ok"))


def missing_keys(docs: DataFrame, json: str, required: list[str]) -> DataFrame:
    return docs.withColumn("missing", F.array_except(F.array(*[F.lit(k) for k in required]), F.json_object_keys(json)))


def first_existing(candidates: DataFrame, assets: DataFrame) -> DataFrame:
    """Best-priority candidate path per key that exists; null when none does."""
    hit = candidates.join(assets.select("path").distinct(), "path", "left_semi")
    best = hit.groupBy("key").agg(F.min_by("path", "priority").alias("path"))
    return candidates.select("key").distinct().join(best, "key", "left")


def split_filter(catalog: DataFrame, splits: DataFrame, split: str) -> DataFrame:
    """Rasters listed for ``split``; an empty list means no filter."""
    want = splits.filter(F.col("split") == split).select("stem")
    return catalog if want.isEmpty() else catalog.join(want, "stem", "left_semi")
