"""Data-quality rules: every rule is a query giving issue rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridrun.functions.rules import ALLOWED_EPSG
from gridrun.operators.vector import validity


def _issue(df: DataFrame, severity: str, category: str, asset: Column, message: Column) -> DataFrame:
    return df.select(F.lit(severity).alias("severity"), F.lit(category).alias("category"), "source", asset.alias("asset"), message.alias("message"))


def crs_issues(catalog: DataFrame, allowed: list[int] = ALLOWED_EPSG) -> DataFrame:
    """Missing CRS is critical; a CRS outside a non-empty allow-list is high."""
    ok = catalog.filter("readable")
    a = _issue(ok.filter("epsg is null"), "critical", "crs", F.col("stem"), F.lit("Missing CRS"))
    if not allowed:
        return a
    bad = ok.filter(F.col("epsg").isNotNull() & ~F.col("epsg").isin(allowed))
    return a.unionByName(_issue(bad, "high", "crs", F.col("stem"), F.concat(F.lit("Unexpected EPSG: "), F.col("epsg").cast("string"))))


def missing_layers(features: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected (source, class) layers without a counterpart."""
    return expected.join(features.select("source", "class_id").distinct(), ["source", "class_id"], "left_anti")


def preflight(catalog: DataFrame, features: DataFrame, expected: DataFrame, allowed: list[int] = ALLOWED_EPSG) -> DataFrame:
    """All rules at once: readability, CRS, missing, empty and invalid layers."""
    layer = F.concat(F.col("source"), F.lit("/class_"), F.col("class_id").cast("string"))
    v = validity(features).groupBy("source", "class_id").agg(
        F.count_if(F.size("rings") > 0).alias("filled"), F.count_if((F.col("defect") != "empty") & F.col("defect").isNotNull()).alias("bad"))
    # Both rules over the counts in one pass, so that features are looked through once.
    told = lambda cond, category, message: F.when(cond, F.struct(F.lit("high").alias("severity"), F.lit(category).alias("category"), message.alias("message")))
    found = v.select("source", layer.alias("asset"), F.explode(F.array_compact(F.array(
        told(F.col("filled") == 0, "annotation", F.lit("Layer has 0 features")),
        told(F.col("bad") > 0, "geometry", F.concat(F.lit("Invalid geometries: "), F.col("bad").cast("string")))))).alias("i"))
    rules = [
        _issue(catalog.filter("not readable"), "critical", "integrity", F.col("stem"), F.lit("Unreadable raster")),
        crs_issues(catalog, allowed),
        _issue(missing_layers(features, expected), "critical", "annotation", layer, F.lit("Missing layer")),
        found.select("i.severity", "i.category", "source", "asset", "i.message"),
    ]
    return reduce(DataFrame.unionByName, rules)


def verdict(issues: DataFrame) -> DataFrame:
    """``ok`` when nothing is critical or high, with counts by severity."""
    n = lambda s: F.count_if(F.col("severity") == s)
    return issues.agg(((n("critical") + n("high")) == 0).alias("ok"), n("critical").alias("critical"), n("high").alias("high"), F.count("*").alias("issues"))


def grid_match(a: DataFrame, b: DataFrame) -> DataFrame:
    """Prediction against source grid: CRS, affine and shape equality, scores and status.

    Both sides carry epsg, gt_a, gt_c, gt_e, gt_f, width and height; ``b`` is
    the source with columns prefixed ``s_`` and may be missing (null).
    """
    eq = lambda *cols: reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"s_{c}")) for c in cols])
    d = a.join(b, "stem", "left")
    found = F.col("s_width").isNotNull()
    crs, tr, sh = found & eq("epsg"), found & eq("gt_a", "gt_c", "gt_e", "gt_f"), found & eq("width", "height")
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    return d.withColumn("crs_match", crs).withColumn("transform_match", tr).withColumn("shape_match", sh).withColumn(
        "pixel_alignment_score", one(tr & sh)).withColumn("geometry_alignment_score", one(crs & tr)).withColumn(
        "status", F.when(crs & tr & sh, "PASS").otherwise("FAIL"))
