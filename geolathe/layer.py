"""Layers: a DataFrame with an explicit row order, attribute fields and, maybe, a geometry column."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geolathe.session import cut

FID, GEOM = "_fid", "_geom"

#: Points of a feature, and parts (rings or lines) of points.
POINT_TYPE = T.ArrayType(T.ArrayType(T.DoubleType()))
PATH_TYPE = T.ArrayType(POINT_TYPE)


class LayerError(ValueError):
    """A command that can't be applied to a layer."""


@dataclass(frozen=True)
class Layer:
    """``df`` has ``_fid`` (row order and identity), the fields, and ``_geom`` if ``geometry_type`` is set.

    Geometry types are ``point`` (array of [x, y]) and ``polyline`` / ``polygon`` (array of parts). Outer rings turn
    clockwise, holes the other way. A feature may have no geometry (null).
    """

    df: DataFrame
    name: str = ""
    geometry_type: str | None = None
    crs: str | None = None
    info: dict = field(default_factory=dict)

    @property
    def fields(self) -> list[str]:
        return [c for c in self.df.columns if c not in (FID, GEOM)]

    @property
    def system(self) -> list[str]:
        return [c for c in (FID, GEOM) if c in self.df.columns]

    def with_df(self, df: DataFrame, **changes: object) -> Layer:
        return replace(self, df=df, **changes)

    def need(self, *names: str) -> None:
        missing = [n for n in names if n not in self.fields]
        if missing:
            raise LayerError(f"unknown field{'s' * (len(missing) > 1)}: {', '.join(missing)}")

    def need_geometry(self, *types: str) -> None:
        if self.geometry_type not in types:
            raise LayerError(f"this needs a layer of {' or '.join(types)}, not {self.geometry_type or 'a table'}")

    @property
    def lat_long(self) -> bool:
        return self.crs in ("wgs84", "EPSG:4326", "longlat")

    @property
    def settled(self) -> DataFrame:
        """``df`` with its geometry computed before anything that reads it: Python functions take it as a plain column.

        The optimizer merges projections, and Python functions over merged nested lambdas can't be planned; a
        projection with a non-deterministic part isn't merged.
        """
        if GEOM not in self.df.columns:
            return self.df
        return self.df.withColumn(GEOM, F.when(F.monotonically_increasing_id() >= 0, F.col(GEOM)))

    def ordered(self) -> DataFrame:
        """The fields in row order, for output."""
        return self.df.orderBy(FID).drop(FID)


#: Partitions up to which their offsets are part of the expression.
LITERALS = 1_000


def with_fid(df: DataFrame, shuffled: bool = False) -> DataFrame:
    """``df`` with dense row numbers in the order of its partitions: two passes and no shuffle or single task.

    The second pass adds to each row's place in its partition the rows of the partitions before; their number, not
    that of the rows, is what goes through the driver. Both passes must see the same partitions: what comes out of a
    sort or another shuffle (``shuffled``) is checkpointed first, as range bounds are drawn anew on every run.
    """
    df = cut(df) if shuffled else df
    own = df.withColumn("_mono", F.monotonically_increasing_id())
    part = F.shiftright("_mono", 33)
    counts = {r["p"]: r["n"] for r in own.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, offsets = 0, []
    for p in range(max(counts, default=-1) + 1):
        offsets.append(before)
        before += counts.get(p, 0)
    if len(offsets) > LITERALS:
        table = df.sparkSession.createDataFrame(list(enumerate(offsets)), "_part int, _before bigint")
        own = own.withColumn("_part", part.cast("int")).join(F.broadcast(table), "_part")  # a row per partition
        at = F.col("_before")
    else:
        at = F.get(F.array(*[F.lit(o) for o in offsets]), part.cast("int")) if offsets else F.lit(0)
    return own.select((at + F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1))).cast("long").alias(FID), *[F.col(f"`{c}`") for c in df.columns if c != FID])


def layer_of(df: DataFrame, name: str = "", key: str | None = None, **options: object) -> Layer:
    """A layer of a table. ``key``: a unique integer column that gives the order; without it, the order of the rows."""
    numbered = df.select(F.col(key).cast("long").alias(FID), *[F.col(f"`{c}`") for c in df.columns]) if key else with_fid(df)
    return Layer(numbered, name, **options)  # type: ignore[arg-type]


def points_of(layer: Layer, x: str, y: str, **options: object) -> Layer:
    """A point layer from two numeric columns; null points where either is missing."""
    c = [F.col(x).cast("double"), F.col(y).cast("double")]
    good = c[0].isNotNull() & c[1].isNotNull() & ~F.isnan(c[0]) & ~F.isnan(c[1])
    return layer.with_df(layer.df.withColumn(GEOM, F.when(good, F.array(F.array(*c)))), geometry_type="point", **options)
