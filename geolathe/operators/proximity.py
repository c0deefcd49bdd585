"""Points near other points, and the regions that contain points, through grid cells.

Pairs: every point has a home cell and visits the few cells within the radius; an equi-join of visits and homes on the
cell gives the candidates, an exact distance decides. Full cells are cut into blocks of both sides. Regions: points
meet regions by cell, in grids as coarse as each region is large; an exact point-in-polygon test decides. Points
without the coordinates (null or NaN) take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolathe.functions.regions import Regions
from geolathe.plans.skew import salted_join
from geolathe.session import written

EARTH_M = 6378137.0
#: Side of a cell in radii: larger cells are visited from fewer neighbours but hold more candidates.
SIDE = 4
#: Regions with up to so many vertices in all are sent to every executor, indexed once (32 bytes for an edge, which is a
#: vertex's); beyond, they are shuffled.
SENT_VERTICES = 1_000_000


def _packed(cx: Column, cy: Column) -> Column:
    """Two cell numbers of 32 bits in one key."""
    return F.shiftleft(cx, 32).bitwiseOR(cy.bitwiseAND(F.lit(0xFFFFFFFF)))


def _floor(x: Column) -> Column:
    return F.floor(x).cast("long")


def placed(points: DataFrame, id_col: str, x: str, y: str) -> DataFrame:
    """id, x, y of the points that have both coordinates."""
    df = points.select(F.col(id_col).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    return df.where(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))


def _located(df: DataFrame, radius: float, sphere: bool) -> DataFrame:
    """``df`` with the home cell of each point and the cells that it visits."""
    if not sphere:
        side = SIDE * radius
        span = lambda c: F.sequence(_floor((c - radius) / side), _floor((c + radius) / side))
        visits = F.flatten(F.transform(span(F.col("x")), lambda i: F.transform(span(F.col("y")), lambda j: _packed(i, j))))
        return df.withColumns({"home": _packed(_floor(F.col("x") / side), _floor(F.col("y") / side)), "visits": visits})
    # bands of latitude, each cut into as many cells as keep them a few radii wide at its edge nearer to a pole
    step = min(180.0, math.degrees(SIDE * radius / EARTH_M))
    reach = math.degrees(radius / EARTH_M) * 1.000001

    def columns(row: Column) -> Column:
        edge = F.least(F.lit(90.0), F.greatest(F.abs(row * step), F.abs((row + 1) * step)))
        return F.greatest(F.lit(1), F.floor(F.lit(360.0) * F.cos(F.radians(edge)) / step)).cast("long")

    east = F.pmod(F.col("x") + 180.0, F.lit(360.0))
    home_row = _floor(F.col("y") / step)
    home = _packed(home_row, F.pmod(_floor(east / (F.lit(360.0) / columns(home_row))), columns(home_row)))

    def visited(row: Column) -> Column:
        top = F.least(F.lit(90.0), F.abs(F.col("y")) + reach)
        # the widest stretch of longitude within reach; near a pole all of it
        wide = F.when(top >= 90 - reach, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(F.lit(reach))) / F.cos(F.radians(top))))) * 1.000001)
        n, width = columns(row), F.lit(360.0) / columns(row)
        cells = F.sequence(_floor((east - wide) / width), _floor((east + wide) / width))
        return F.array_distinct(F.transform(cells, lambda c: _packed(row, F.pmod(c, n))))

    rows = F.sequence(_floor((F.col("y") - reach) / step), _floor((F.col("y") + reach) / step))
    return df.where(F.col("y").between(-90, 90)).withColumns({"home": home, "visits": F.flatten(F.transform(rows, visited))})


#: Points of a cell beyond which it is cut into blocks, and cells with blocks that may be sent to every executor.
BLOCK, SENT_CELLS = 4_000, 20_000


def _blocked(visitors: DataFrame, homes: DataFrame, visitor: str, home: str, own: bool = False) -> DataFrame:
    """Visitors and homes that share a ``cell``. Both sides of a full cell are cut into pieces of at most about
    ``BLOCK`` rows, and every piece of one side meets every piece of the other in a block of its own. With ``own``
    every home is among the visitors of its cell, so only these are counted."""
    zero = F.lit(0).cast("long")
    sizes = visitors.groupBy("cell").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes if own else sizes.unionByName(homes.groupBy("cell").agg(F.count(F.lit(1)).alias("_n")))
    full = written(sizes.where(F.col("_n") > BLOCK).groupBy("cell").agg(F.ceil(F.max("_n") / BLOCK).cast("long").alias("_p")), "cells")
    cells = full.count()
    if not cells:
        return visitors.join(homes, "cell")
    full = F.broadcast(full) if cells <= SENT_CELLS else full

    def cut(df: DataFrame, id_col: str, own: str, other: str) -> DataFrame:
        df = df.join(full, "cell", "left")
        piece = F.coalesce(F.pmod(F.xxhash64(id_col), F.col("_p")), zero)
        return df.withColumn(own, piece).withColumn(other, F.explode(F.sequence(zero, F.coalesce(F.col("_p") - 1, zero)))).drop("_p")

    return cut(visitors, visitor, "_v", "_h").join(cut(homes, home, "_h", "_v"), ["cell", "_v", "_h"]).drop("_v", "_h")


def _pairs(df: DataFrame, close: Column) -> DataFrame:
    homes = df.select(F.col("home").alias("cell"), F.col("id").alias("id_lo"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    visitors = df.select(F.explode("visits").alias("cell"), F.col("id").alias("id_hi"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return _blocked(visitors, homes, "id_hi", "id_lo", own=True).where((F.col("id_lo") < F.col("id_hi")) & close).select("id_lo", "id_hi")


def near_planar(points: DataFrame, id_col: str, x: str, y: str, radius: float) -> DataFrame:
    """Pairs (id_lo < id_hi) of points at most ``radius`` apart in the plane; each pair once.

    Points at one place pair with each other. Ids must be unique; rows without both coordinates are left out.
    """
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    return _pairs(_located(placed(points, id_col, x, y), radius, False), dx * dx + dy * dy <= F.lit(float(radius) ** 2))


def great_circle(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Haversine distance in metres between two longitudes and latitudes in degrees."""
    rad = lambda c: F.radians(c)
    h = F.pow(F.sin((rad(by) - rad(ay)) / 2), 2) + F.cos(rad(ay)) * F.cos(rad(by)) * F.pow(F.sin((rad(bx) - rad(ax)) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def near_sphere(points: DataFrame, id_col: str, lng: str, lat: str, radius_m: float) -> DataFrame:
    """Pairs of points at most ``radius_m`` apart along the great circle, across the antimeridian and at the poles too."""
    return _pairs(_located(placed(points, id_col, lng, lat), radius_m, True), great_circle(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")) <= radius_m)


def near_pairs_between(left: DataFrame, right: DataFrame, id_col: str, distance: float, sphere: bool = False) -> DataFrame:
    """(_t, _s) of points x, y of two tables at most ``distance`` apart, without repeats."""
    places = [_located(placed(df, id_col, "x", "y"), distance, sphere) for df in (left, right)]
    visitors = places[0].select(F.explode("visits").alias("cell"), F.col("id").alias("_t"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    homes = places[1].select(F.col("home").alias("cell"), F.col("id").alias("_s"), F.col("x").alias("bx"), F.col("y").alias("by"))
    joined = _blocked(visitors, homes, "_t", "_s")
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    close = great_circle(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")) <= distance if sphere else dx * dx + dy * dy <= F.lit(float(distance) ** 2)
    return joined.where(close).select("_t", "_s").distinct()


def near_counts(points: DataFrame, id_col: str, x: str, y: str, radius: float) -> DataFrame:
    """One row per placed point: its place (the smallest id at exactly its coordinates) and its number of near points.

    Copies at one place are joined as one point with its multiplicity, never expanded into pairs.
    """
    df = placed(points, id_col, x, y)
    places = df.groupBy("x", "y").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    pairs = near_planar(places, "id", "x", "y", radius)
    sizes = places.select("id", "n")
    links = pairs.unionByName(pairs.select(F.col("id_hi").alias("id_lo"), F.col("id_lo").alias("id_hi")))
    others = links.join(sizes, links.id_hi == sizes.id).groupBy("id_lo").agg(F.sum("n").alias("m"))
    total = places.join(others, places.id == others.id_lo, "left").select("x", "y", F.col("id").alias("place"), (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n_near"))
    out = salted_join(df, total, ["x", "y"], F.col("id"), "inner")
    return out.select(F.col("id").alias(id_col), "place", "n_near")


def _batches(batches: Iterator[pa.RecordBatch], rows: int = 60_000) -> Iterator[pa.Table]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def containing(points: DataFrame, id_col: str, x: str, y: str, regions: DataFrame, region_id: str, coordinates: str, sent_vertices: int = SENT_VERTICES) -> DataFrame:
    """(id, region) for every point and region containing it; overlapping regions give a row each.

    ``coordinates`` is a list of polygons, each a list of rings of [x, y] in the points' coordinates. The regions'
    vertices are counted first: up to ``sent_vertices`` they go to every executor, beyond that points and regions
    are shuffled by tile. Regions without rings contain nothing.
    """
    df = placed(points, id_col, x, y)
    shapes = regions.select(F.col(region_id).alias("region"), F.col(coordinates).alias("shape")).where(F.col("shape").isNotNull())
    vertices = F.aggregate(F.flatten(F.col("shape")), F.lit(0).cast("long"), lambda n, ring: n + F.coalesce(F.size(ring), F.lit(0)))
    total = shapes.agg(F.sum(vertices)).first()[0] or 0
    id_type, region_type = df.schema["id"].dataType.simpleString(), shapes.schema["region"].dataType.simpleString()
    schema = f"id {id_type}, region {region_type}"
    if total <= sent_vertices:
        sent = points.sparkSession.sparkContext.broadcast(Regions((r.region, r.shape) for r in shapes.toLocalIterator()))

        def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for t in _batches(batches):
                at, region = index.containing(t["x"].to_numpy(), t["y"].to_numpy())
                yield from pa.table({"id": t["id"].take(pa.array(at)), "region": pa.array(region.tolist())}, schema=pa.schema([("id", t.schema.field("id").type), ("region", pa.string() if region_type == "string" else pa.int64())])).to_batches()

        return df.mapInArrow(test, schema)
    return _by_tile(df, shapes, schema)


def level_of(width: Column, height: Column, w: float, h: float) -> Column:
    """How many times the side of a cell must be quadrupled until a box covers at most a few cells."""
    return F.greatest(F.lit(0), F.ceil(F.log(4.0, F.greatest(width / w, height / h, F.lit(1e-9))))).cast("int")


def cells_at(level: Column, x0: Column, x1: Column, y0: Column, y1: Column, w: float, h: float) -> Column:
    """The cells (level, i, j) that a box covers in the grid of a level."""
    k = F.pow(F.lit(4.0), level)
    span = lambda a, b, s: F.sequence(_floor(a / (s * k)), _floor(b / (s * k)))
    return F.flatten(F.transform(span(x0, x1, w), lambda i: F.transform(span(y0, y1, h), lambda j: F.struct(level.alias("level"), i.alias("i"), j.alias("j")))))


def _by_tile(df: DataFrame, shapes: DataFrame, schema: str) -> DataFrame:
    """The shuffled way: tiles two mean regions wide, in coarser grids for larger regions, so that none covers more
    than a few tiles; points are placed in each grid there is. Hot tiles are cut into pieces of their points."""
    from geolathe.plans.skew import SALTS, hot_keys

    flat = F.flatten(F.flatten(F.col("shape")))
    xs, ys = F.transform(flat, lambda p: F.get(p, F.lit(0))), F.transform(flat, lambda p: F.get(p, F.lit(1)))
    boxed = shapes.select(
        "region", "shape",
        F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"),
    ).where(F.col("x0").isNotNull() & F.col("y0").isNotNull())
    w, h = boxed.agg(F.avg(F.col("x1") - F.col("x0")), F.avg(F.col("y1") - F.col("y0"))).first()
    w, h = 2 * (w or 1.0), 2 * (h or 1.0)
    boxed = boxed.withColumn("level", level_of(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), w, h))
    levels = [r[0] for r in boxed.select("level").distinct().collect()] or [0]  # a few dozen at most: logarithms of doubles
    tiles = boxed.select("region", "shape", F.explode(cells_at(F.col("level"), F.col("x0"), F.col("x1"), F.col("y0"), F.col("y1"), w, h)).alias("tile"))
    pts = df.withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    pts = pts.withColumn("tile", cells_at(F.col("level"), F.col("x"), F.col("x"), F.col("y"), F.col("y"), w, h)[0]).drop("level")
    heavy = hot_keys(pts, ["tile"])
    zero = F.lit(0).cast("long")
    if heavy is not None:
        heavy = F.broadcast(heavy.withColumn("_hot", F.lit(True)))
        pts = pts.join(heavy, "tile", "left").withColumn("piece", F.when(F.col("_hot"), F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(zero)).drop("_hot")
        tiles = tiles.join(heavy, "tile", "left").withColumn("piece", F.explode(F.when(F.col("_hot"), F.sequence(zero, F.lit(SALTS - 1).cast("long"))).otherwise(F.array(zero)))).drop("_hot")
    else:
        pts, tiles = pts.withColumn("piece", zero), tiles.withColumn("piece", zero)

    def test(p: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(r):
            return pd.DataFrame({"id": p["id"].iloc[:0], "region": r["region"].iloc[:0]})
        at, region = Regions(zip(r["region"], r["shape"])).containing(p["x"].to_numpy(float), p["y"].to_numpy(float))
        return pd.DataFrame({"id": p["id"].to_numpy()[at], "region": region})

    return pts.groupBy("tile", "piece").cogroup(tiles.groupBy("tile", "piece")).applyInPandas(test, schema)
