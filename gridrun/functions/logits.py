"""Column expressions over per-pixel class scores ``z ARRAY<DOUBLE>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridrun.constants import ENSEMBLE_WEIGHTS


def softmax(z: Column | str) -> Column:
    """Shifted softmax with 1e-9 in the denominator."""
    z = F.col(z) if isinstance(z, str) else z
    e = F.transform(z, lambda x: F.exp(x - F.array_max(z)))
    # A one-element array holds the shifted exponentials so they are computed once.
    return F.transform(F.array(e), lambda v: F.transform(
        v, lambda x: x / (F.aggregate(v, F.lit(0.0), lambda a, b: a + b) + F.lit(1e-9))))[0]


def argmax(z: Column | str) -> Column:
    """Index of the largest score; the first index wins ties."""
    return (F.array_position(z, F.array_max(z)) - 1).cast("int")


def confidence(z: Column | str) -> Column:
    return F.array_max(softmax(z))


def add_bias(z: Column | str, bias: list[float]) -> Column:
    return F.zip_with(z, F.array(*[F.lit(float(b)) for b in bias]), lambda a, b: a + b)


def ensemble(a: Column | str, b: Column | str, weights=ENSEMBLE_WEIGHTS) -> Column:
    return F.zip_with(a, b, lambda x, y: F.lit(weights[0]) * x + F.lit(weights[1]) * y)


def entropy(p: Column | str) -> Column:
    return -F.aggregate(p, F.lit(0.0), lambda s, x: s + x * F.log(x + F.lit(1e-10)))


def cross_entropy(z: Column | str, gt: Column | str) -> Column:
    """``log(sum(exp(z))) - z[gt]``, shifted by the maximum."""
    z = F.col(z) if isinstance(z, str) else z
    m = F.array_max(z)
    lse = F.log(F.aggregate(F.transform(z, lambda x: F.exp(x - m)), F.lit(0.0), lambda a, b: a + b)) + m
    return lse - F.element_at(z, (F.col(gt) if isinstance(gt, str) else gt) + 1)


def confidence_band(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c < 0.4, "low").when(c < 0.7, "medium").otherwise("high")
