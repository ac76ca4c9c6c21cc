"""Seeded draws from the key columns of a row: an arithmetic reading of a digest, the same in every engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 52      # so that a draw plus a half is exact in a double


def draw(seed: int, *keys) -> Column:
    """Whole number below 2^52 from the first 13 hexadecimal digits of the digest of seed and keys, joined by colons."""
    columns = [F.col(k) if isinstance(k, str) else k for k in keys]
    text = F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long")


def uniform(seed: int, *keys) -> Column:
    """Uniform in (0, 1) from the key columns."""
    return (draw(seed, *keys).cast("double") + 0.5) / float(1 << BITS)
