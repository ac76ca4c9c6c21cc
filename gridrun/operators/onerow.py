"""Attach the columns of a one-row table as scalar subqueries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Add every column of ``one`` to each row; fails if ``one`` has several rows.

    A scalar subquery, not a cross join: the value is computed once.
    """
    packed = one.select(F.struct(*one.columns).alias("_one")).scalar()
    return df.withColumn("_one", packed).select("*", *[F.col("_one")[c].alias(c) for c in one.columns]).drop("_one")
