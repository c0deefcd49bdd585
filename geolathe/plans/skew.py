"""Joins that stay balanced when a few keys hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of the rows on; so there are at most 1 / HOT_SHARE hot keys, whatever the data.
HOT_SHARE = 1 / 256
#: Pieces a hot key is split into.
SALTS = 32


def hot_keys(df: DataFrame, keys: list[str], share: float = HOT_SHARE, least: int = 10_000, counts: DataFrame | None = None) -> DataFrame | None:
    """Keys holding more than ``share`` of the rows (and more than ``least`` rows), or None if there are none.

    The counts are combined before the shuffle; at most 1 / share rows come back, so the result may be broadcast.
    ``counts``: rows per key (``_n``), where they are known already.
    """
    given = counts is not None
    counts = counts if given else df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    rows = counts.where(F.col("_n") > least).orderBy(F.desc("_n")).limit(int(1 / share) + 1).collect()
    if not rows:
        return None
    total = counts.agg(F.sum("_n")).first()[0] if given else df.count()
    rows = [tuple(r[k] for k in keys) for r in rows if r["_n"] > total * share]
    if not rows:
        return None
    schema = counts.select(*keys).schema
    return df.sparkSession.createDataFrame(rows, schema)


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], spread: Column, how: str = "left", salts: int = SALTS, **hot: object) -> DataFrame:
    """Equi-join of a possibly skewed ``left`` with a ``right`` whose keys are unique or few.

    Rows of hot keys are spread over ``salts`` pieces by ``spread`` (an id of the left row); the right rows of
    those keys, and only those, are repeated once per piece. Null keys match nothing, as in any equi-join.
    """
    heavy = hot_keys(left, keys, **hot)
    if heavy is None:
        return left.join(right, keys, how)
    heavy = F.broadcast(heavy.withColumn("_hot", F.lit(True)))
    apart = F.col("_hot")
    for k in keys:  # rows with a null key match nothing and may go anywhere
        apart = apart | F.col(f"`{k}`").isNull()
    left = left.join(heavy, keys, "left").withColumn("_salt", F.when(apart, F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(F.lit(0).cast("long"))).drop("_hot")
    pieces = F.when(F.col("_hot"), F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    right = right.join(heavy, keys, "left").withColumn("_salt", F.explode(pieces)).drop("_hot")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
