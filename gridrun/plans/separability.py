"""Two-class separability of feature vectors with Spark ML."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def class_distance(df: DataFrame, a: int, b: int) -> DataFrame:
    """Distance of the class means and between-to-within variance ratio."""
    d = df.filter(F.col("label").isin(a, b)).select("label", F.posexplode("embedding").alias("i", "x"))
    m = d.groupBy("i").agg(*[f(F.when(F.col("label") == k, F.col("x").cast("double"))).alias(f"{n}{s}") for k, s in ((a, "a"), (b, "b")) for n, f in (("m", F.avg), ("v", F.var_pop))])
    gap = F.pow(F.col("ma") - F.col("mb"), F.lit(2))
    return m.agg(F.round(F.sqrt(F.sum(gap)), 6).alias("centroid_distance"), F.round(F.sum(gap) / (F.sum(F.col("va") + F.col("vb")) + 1e-9), 6).alias("fisher_ratio"))


def separability(df: DataFrame, a: int, b: int) -> DataFrame:
    """One row: silhouette, logistic AUC on a hash-held-out 30 %, variance kept by two principal axes."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator, ClusteringEvaluator
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    d = df.filter(F.col("label").isin(a, b)).select(
        "vec_id", (F.col("label") == b).cast("int").alias("prediction"), (F.col("label") == b).cast("double").alias("label"),
        array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    part = F.pmod(F.xxhash64("vec_id", F.lit(42)), F.lit(10))
    model = LogisticRegression(maxIter=50, regParam=0.01).fit(d.filter(part < 7).select("label", "features"))
    auc = BinaryClassificationEvaluator().evaluate(model.transform(d.filter(part >= 7).select("label", "features")))
    sil = ClusteringEvaluator().evaluate(d.select("prediction", "features"))
    kept = float(sum(PCA(k=2, inputCol="features", outputCol="p").fit(d).explainedVariance.toArray()))
    return d.agg(F.count("*").alias("n")).select("n", F.lit(sil).alias("silhouette"), F.lit(auc).alias("auc"), F.lit(kept).alias("two_axis_variance"))
