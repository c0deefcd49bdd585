"""Bounded samples that are the same on every run."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hashed_sample(df: DataFrame, key: list[str], size: int, rows: int, seed: int = 5) -> DataFrame:
    """At most ``size`` rows of ``df``, those with the smallest hashes of ``key``; ``rows`` says about how many it has.

    A cut on the hash keeps a little more than ``size`` rows before any are ordered, so what tasks hand over doesn't
    grow with their number.
    """
    h: Column = F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1 << 32))
    if rows > size:
        share = min(1.0, (1.3 * size + 8 * math.sqrt(size)) / rows)
        df = df.where(h < F.lit(int(share * (1 << 32))))
    return df.orderBy(h, *key).limit(size)
