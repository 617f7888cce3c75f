"""Randomness that depends on a seed and a key only, never on row order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(seed, *key) -> Column:
    """md5 of ``seed|key...`` as hex text."""
    parts = [F.lit(str(seed))] + [
        (k if isinstance(k, Column) else F.col(k)).cast("string") for k in key
    ]
    return F.md5(F.concat_ws("|", *parts))


def uniform(seed, *key) -> Column:
    """Uniform double in [0, 1): the first 32 bits of the digest."""
    head = F.conv(F.substring(digest(seed, *key), 1, 8), 16, 10).cast("long")
    return head / F.lit(4294967296.0)


def between(low: float, high: float, seed, *key) -> Column:
    return F.lit(float(low)) + uniform(seed, *key) * F.lit(float(high - low))


def integer(low, high, seed, *key) -> Column:
    """Uniform integer in [low, high], both ends included."""
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return (low + F.floor(uniform(seed, *key) * (high - low + 1))).cast("int")
