"""Polygon overlay: shared areas, clipping, erasing, union, mosaic and cleaning.

Clipping and shared areas go by target feature: candidates meet by cells of their bounds, each feature with its
candidates is one group. Mosaics cut the plane into tiles of the map; a tile holds the pieces of all polygons in it
and is arranged by itself, then edges between pieces with the same owners cancel across the tiles.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolathe.functions import geometry as G
from geolathe.functions import shapes as S
from geolathe.functions.aggregates import compiled, grouped, null_safe
from geolathe.layer import FID, GEOM, Layer, LayerError, with_fid
from geolathe.operators.paths import changed, kernel
from geolathe.operators.proximity import cells_at, level_of
from geolathe.operators.table import dissolve, layer_bounds, merge_layers, translator
from geolathe.operators.topology import edges, outlines
from geolathe.session import written

#: Vertices up to which a layer is arranged as one tile.
TILE_VERTICES = 20_000
SHAPE = "array<array<array<double>>>"


def _boxes(layer: Layer, name: str) -> DataFrame:
    b = G.bounds(F.col(GEOM), layer.geometry_type == "point")
    return layer.df.where(F.col(GEOM).isNotNull()).select(F.col(FID).alias(name), F.col(GEOM).alias(f"_{name}"), *[b[k].alias(f"{name}_{k}") for k in ("xmin", "ymin", "xmax", "ymax")])


def candidates(target: Layer, source: Layer) -> DataFrame:
    """(_t, _s) whose bounds meet: equi-joins on the cells that the bounds cover, no pair twice.

    Cells are twice the mean extent of a source feature wide, and four times as wide on each further level. A feature
    is placed on the level where it covers a few cells only, and meets smaller ones on its own level. A pair is only
    taken in the cell that holds the lower left corner of where the two bounds meet, so nothing needs to be made
    distinct.
    """
    t, s = _boxes(target, "t").drop("_t"), _boxes(source, "s").drop("_s")
    w, h = s.agg(F.avg(F.col("s_xmax") - F.col("s_xmin")), F.avg(F.col("s_ymax") - F.col("s_ymin"))).first()
    w, h = 2 * (w or 1.0), 2 * (h or 1.0)
    t, s = (df.withColumn(f"{n}_level", level_of(F.col(f"{n}_xmax") - F.col(f"{n}_xmin"), F.col(f"{n}_ymax") - F.col(f"{n}_ymin"), w, h)) for df, n in ((t, "t"), (s, "s")))
    found = t.select(F.lit("t").alias("n"), F.col("t_level").alias("l")).union(s.select(F.lit("s"), "s_level")).distinct().collect()  # a few dozen at most
    levels = {n: sorted(r["l"] for r in found if r["n"] == n) for n in "ts"}
    if not levels["t"] or not levels["s"]:
        return target.df.sparkSession.createDataFrame([], "_t bigint, _s bigint")

    def celled(df: DataFrame, n: str, on: list[int] | None = None) -> DataFrame:
        """On its own level, or on those of ``on`` that are coarser or as coarse (for ``s``) as it."""
        if on is None:
            df = df.withColumn("_level", F.col(f"{n}_level"))
        else:
            df = df.withColumn("_level", F.explode(F.array(*map(F.lit, on)))).where((F.col("_level") > F.col(f"{n}_level")) if n == "t" else (F.col("_level") >= F.col(f"{n}_level")))
        b = [F.col(f"{n}_{k}") for k in ("xmin", "xmax", "ymin", "ymax")]
        return df.withColumn("_cell", F.explode(cells_at(F.col("_level"), *b, w, h))).drop("_level")

    x, y = F.greatest("t_xmin", "s_xmin"), F.greatest("t_ymin", "s_ymin")
    k = F.pow(F.lit(4.0), F.col("_cell")["level"])
    meet = (x <= F.least("t_xmax", "s_xmax")) & (y <= F.least("t_ymax", "s_ymax")) & (F.floor(x / (k * w)) == F.col("_cell")["i"]) & (F.floor(y / (k * h)) == F.col("_cell")["j"])
    pairs = celled(t, "t").join(celled(s, "s", levels["t"]), "_cell").where(meet)
    if levels["s"][-1] > levels["t"][0]:
        pairs = pairs.unionByName(celled(t, "t", levels["s"]).join(celled(s, "s"), "_cell").where(meet))
    return pairs.select(F.col("t").alias("_t"), F.col("s").alias("_s"))


def overlap_areas(target: Layer, source: Layer) -> DataFrame:
    """(_t, _s, area) of polygons that share area, pair by pair."""
    t = target.settled.select(F.col(FID).alias("_t"), F.col(GEOM).alias("_tg"))
    s = source.settled.select(F.col(FID).alias("_s"), F.col(GEOM).alias("_sg"))
    pairs = candidates(target, source).join(t, "_t").join(s, "_s")
    shared = kernel(lambda a, b: S.clipped(a, [b]))(F.col("_tg"), F.col("_sg"))
    return pairs.withColumn("_g", shared).select("_t", "_s", G.area(F.col("_g")).alias("area")).where(F.col("area") > 0)


def _by_target(target: Layer, source: Layer, f, kept_alone: bool) -> Layer:  # noqa: ANN001
    """``f(parts, shapes)`` for each target with the source polygons near it; alone it stays (or goes)."""
    s = source.settled.select(F.col(FID).alias("_s"), F.col(GEOM).alias("_sg"))
    near = candidates(target, source).join(s, "_s").groupBy("_t").agg(F.transform(F.array_sort(F.collect_list(F.struct("_s", "_sg"))), lambda x: x["_sg"]).alias("_near"))
    df = target.settled.join(near, F.col(FID) == near["_t"], "left")
    new = kernel(lambda parts, shapes: f(parts, shapes or []) or None)(F.col(GEOM), F.col("_near"))
    out = df.withColumn(GEOM, F.when(F.col("_t").isNull(), F.col(GEOM) if kept_alone else F.lit(None).cast(SHAPE)).otherwise(new))
    return target.with_df(out.where(F.col(GEOM).isNotNull()).drop("_t", "_near"))


def clip(target: Layer, source: Layer, erase: bool = False) -> Layer:
    """What of each feature is inside (``erase``: outside) of the source polygons; emptied features are dropped."""
    source.need_geometry("polygon")
    if target.geometry_type == "point":
        from geolathe.operators.points import clip_points_by

        return clip_points_by(target, source, erase)
    if target.geometry_type == "polyline":
        return _by_target(target, source, lambda parts, shapes: S.line_clipped(parts, shapes, erase), erase)
    target.need_geometry("polygon")
    return _by_target(target, source, lambda parts, shapes: S.clipped(parts, shapes, erase), erase)


def slice_by(target: Layer, source: Layer, id_field: str | None = None) -> dict[str, Layer]:
    """One clipped layer per source polygon, named by a field of it."""
    source.need_geometry("polygon")
    name = F.col(f"`{id_field}`").cast("string") if id_field else F.concat(F.lit("slice-"), F.col(FID).cast("string"))
    keys = [r[0] for r in source.df.select(name.alias("k"), FID).orderBy(FID).select("k").collect()]
    return {k: clip(target, source.with_df(source.df.where(name == k))) for k in dict.fromkeys(keys)}


def divide(lines: Layer, polygons: Layer, fields: list[str] | None = None, force: bool = False) -> Layer:
    """Lines cut at polygon borders, each piece with the fields of the polygon that it is in (null outside)."""
    lines.need_geometry("polyline")
    names = polygons.fields if fields is None or "*" in fields else fields
    names = [n for n in names if force or n not in lines.fields]
    pairs = candidates(lines, polygons)
    s = polygons.df.select(F.col(FID).alias("_s"), F.col(GEOM).alias("_sg"), *[F.col(f"`{n}`").alias(f"_v_{n}") for n in names])
    joined = lines.settled.join(pairs, F.col(FID) == pairs["_t"]).join(s, "_s")
    inside = joined.withColumn(GEOM, kernel(lambda a, b: S.line_clipped(a, [b]) or None)(F.col(GEOM), F.col("_sg"))).where(F.col(GEOM).isNotNull())
    inside = inside.drop("_t", "_sg", *[n for n in names if n in lines.fields]).withColumnsRenamed({f"_v_{n}": n for n in names})
    outside = clip(lines, polygons, erase=True).df.withColumn("_s", F.lit(None).cast("long"))
    outside = outside.drop(*[n for n in names if n in lines.fields])
    both = inside.unionByName(outside, allowMissingColumns=True)
    return lines.with_df(with_fid(both.orderBy(FID, "_s").drop(FID, "_s"), shuffled=True))


# --- mosaics -------------------------------------------------------------------------------------------------------


def tiles(shapes: DataFrame, bounds: list[float] | None, vertices: int, gaps: bool = False) -> DataFrame:
    """Faces of the arrangement of polygons (id, geometry): ``owners`` (sorted ids), geometry, ``gap``.

    Beyond ``TILE_VERTICES`` the map is cut into a grid of tiles, a polygon's piece in each; faces on both sides of a
    tile's border come apart and are merged again by their owners. With ``gaps`` the enclosed places without an owner
    are faces too, with ``gap`` numbering them: pieces of one gap in several tiles have the same number.
    """
    schema = f"owners array<bigint>, {GEOM} {SHAPE}, outer boolean"
    if bounds is None:
        return shapes.sparkSession.createDataFrame([], f"owners array<bigint>, {GEOM} {SHAPE}, gap bigint")
    n = max(1, math.ceil(math.sqrt(vertices / TILE_VERTICES)))
    x0, y0, x1, y1 = bounds
    if gaps and n > 1:  # a margin around the map, so that what isn't enclosed meets its border
        mx, my = (x1 - x0) / 64 or 1.0, (y1 - y0) / 64 or 1.0
        x0, y0, x1, y1 = x0 - mx, y0 - my, x1 + mx, y1 + my
    w, h = (x1 - x0) / n or 1.0, (y1 - y0) / n or 1.0
    b = G.bounds(F.col(GEOM), False)
    at = lambda c, o, s: F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor((c - o) / s))).cast("int")
    placed = shapes.where(F.col(GEOM).isNotNull()).withColumn("tx", F.explode(F.sequence(at(b["xmin"], x0, w), at(b["xmax"], x0, w)))).withColumn("ty", F.explode(F.sequence(at(b["ymin"], y0, h), at(b["ymax"], y0, h))))
    if gaps and n > 1:  # tiles without a polygon may lie within a gap
        every = shapes.sparkSession.range(n * n).select(F.lit(-1).cast("long").alias("id"), F.lit(None).cast(SHAPE).alias(GEOM), (F.col("id") % n).cast("int").alias("tx"), F.floor(F.col("id") / n).cast("int").alias("ty"))
        placed = placed.select("id", GEOM, "tx", "ty").unionByName(every)

    size = max(abs(v) for v in (x0, y0, x1, y1))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        tx, ty = int(pdf["tx"].iloc[0]), int(pdf["ty"].iloc[0])
        geoms = [[[list(map(float, p[:2])) for p in r] for r in g] if g is not None else [] for g in pdf[GEOM]]
        ids = pdf["id"].tolist()
        if n > 1:
            box = (x0 + tx * w, y0 + ty * h, x0 + (tx + 1) * w if tx < n - 1 else x1, y0 + (ty + 1) * h if ty < n - 1 else y1)
            geoms = [[c for r in g if (c := S.clip_ring(r, box))] for g in geoms]
            if gaps:  # the tile itself, so that its border bounds what has no owner
                geoms[0] = [[[box[0], box[1]], [box[0], box[3]], [box[2], box[3]], [box[2], box[1]], [box[0], box[1]]]]
        rows = []
        for t, held in S.mosaic(geoms, size):
            owners = [int(ids[i]) for i in held if ids[i] >= 0]
            outer = n > 1 and any(abs(p[0] - v) <= 1e-9 * size for r in t for p in r for v in (x0, x1)) or n > 1 and any(abs(p[1] - v) <= 1e-9 * size for r in t for p in r for v in (y0, y1))
            rows.append((owners, t, outer))
        return pd.DataFrame(rows, columns=["owners", GEOM, "outer"])

    made = placed.groupBy("tx", "ty").applyInPandas(run, schema)
    none = F.lit(None).cast("long").alias("gap")
    if n == 1 and not gaps:
        return made.select("owners", GEOM, none)
    numbered = with_fid(made, shuffled=True)
    if n == 1:
        return numbered.select("owners", GEOM, F.when(F.size("owners") == 0, F.col(FID)).alias("gap"))
    owned = numbered.where(F.size("owners") > 0)
    keys = owned.groupBy("owners").agg(F.min(FID).alias("_g"))
    faces = Layer(owned.select(FID, GEOM), "", "polygon")
    merged = outlines(edges(faces).join(owned.select(FID, "owners").join(keys, "owners").select(FID, "_g"), FID))
    groups = merged.join(keys, "_g").select("owners", F.explode(kernel(S.nested, "array<array<array<array<double>>>>")(F.col(GEOM))).alias(GEOM), none)
    if not gaps:
        return groups
    from geolathe.operators.classify import components

    free = numbered.where(F.size("owners") == 0)
    sides = edges(Layer(free.select(FID, GEOM), "", "polygon")).groupBy(FID).agg(F.collect_list(F.to_json(F.struct("p", "q"))).alias("m"))
    linked = free.join(components(sides, FID, "m").withColumnRenamed("component", "gap"), FID)
    enclosed = linked.groupBy("gap").agg(F.bool_or("outer").alias("o")).where(~F.col("o")).select("gap")
    return groups.unionByName(linked.join(enclosed, "gap").select("owners", GEOM, "gap"))


def _vertices(layer: Layer) -> int:
    return int(layer.df.agg(F.sum(G.over_parts(F.col(GEOM), lambda p: F.size(p).cast("double")))).first()[0] or 0)


def mosaic(layer: Layer, calc: str | None = None, defs: dict | None = None) -> Layer:
    """Overlapping polygons as tiles without overlaps; ``calc`` runs over the polygons of a tile."""
    layer.need_geometry("polygon")
    faces = tiles(layer.df.select(F.col(FID).alias("id"), GEOM), layer_bounds(layer), _vertices(layer)).where(F.size("owners") > 0)
    out = with_fid(faces.orderBy("owners"), shuffled=True)
    if not calc:
        return layer.with_df(out.drop("owners"))
    rows = out.select(F.col(FID).alias("_tile"), F.explode("owners").alias(FID)).join(layer.df.drop(GEOM), FID)
    plan, outputs = compiled(calc, translator(layer, defs), point=None)
    values = grouped(rows, ["_tile"], plan).select("_tile", *[v.col.alias(n) for n, v in outputs])
    return layer.with_df(out.join(values, out[FID] == values["_tile"]).drop("_tile", "owners"))


def union(layers: list[Layer], fields: list[str] | None = None) -> Layer:
    """Full overlay of two or more polygon layers: tiles with the fields of the first polygon of each layer.

    Fields of the same name get a number behind them; a layer without a polygon at a tile gives nulls.
    """
    if len(layers) < 2:
        raise LayerError("a union needs two or more layers")
    shapes, offset, parts, box = None, 0, [], None
    for i, x in enumerate(layers):
        x.need_geometry("polygon")
        top = int(x.df.agg(F.max(FID)).first()[0] or 0) + 1
        own = x.df.select((F.col(FID) + offset).alias("id"), GEOM)
        shapes = own if shapes is None else shapes.unionByName(own)
        names = x.fields if fields is None or "*" in fields else [f for f in x.fields if f in fields]
        parts.append((i, offset, offset + top, names, x))
        offset += top
        b = layer_bounds(x)
        box = b if box is None else box if b is None else [min(box[0], b[0]), min(box[1], b[1]), max(box[2], b[2]), max(box[3], b[3])]
    faces = with_fid(tiles(shapes, box, sum(_vertices(x) for x in layers)).where(F.size("owners") > 0).orderBy("owners"), shuffled=True)
    out, taken = faces, set()
    for i, low, high, names, x in parts:
        first = F.array_min(F.filter("owners", _between(low, high)))
        renamed = {}
        for f in names:
            new, k = f, 2
            while new in taken:
                new, k = f"{f}_{k}", k + 1
            taken.add(new)
            renamed[f] = new
        vals = x.df.select((F.col(FID) + low).alias(f"_o{i}"), *[F.col(f"`{f}`").alias(n) for f, n in renamed.items()])
        out = out.withColumn(f"_k{i}", first).join(vals, F.col(f"_k{i}") == F.col(f"_o{i}"), "left").drop(f"_k{i}", f"_o{i}")
    return Layer(out.drop("owners"), "union", "polygon", layers[0].crs)


def _between(low: int, high: int):  # noqa: ANN202
    return lambda o: (o >= low) & (o < high)


def clean(layer: Layer, gap_area: float = 0.0, allow_overlaps: bool = False) -> Layer:
    """Polygons without crossings and overlaps: a tile goes to the first of its owners; small gaps to a neighbour.

    Lines are cut where they cross and repeated segments dropped by the arrangement; polygons left with nothing
    become null.
    """
    if layer.geometry_type == "polyline":
        return changed(layer, lambda parts: [p for p in parts if len(p) > 1])
    layer.need_geometry("polygon")
    if allow_overlaps:
        return changed(layer, S.cleaned)
    faces = tiles(layer.df.select(F.col(FID).alias("id"), GEOM), layer_bounds(layer), _vertices(layer), gaps=bool(gap_area))
    owned = faces.where(F.size("owners") > 0).select(F.get("owners", F.lit(0)).alias("_g"), GEOM)
    if gap_area:
        free = written(faces.where(F.size("owners") == 0).select("gap", GEOM), "gaps")
        small = free.groupBy("gap").agg(F.sum(G.area(F.col(GEOM))).alias("a")).where(F.col("a") <= gap_area).select("gap")
        free = with_fid(free.join(small, "gap"), shuffled=True)
        ol = Layer(with_fid(owned, shuffled=True), "", "polygon")
        ge = edges(Layer(free.select(FID, GEOM), "", "polygon")).join(free.select(FID, "gap"), FID).select("gap", "p", "q")
        oe = edges(ol).join(ol.df.select(FID, "_g"), FID).select("_g", "p", "q")
        size = G.distance(F.col("p")["x"], F.col("p")["y"], F.col("q")["x"], F.col("q")["y"])
        best = ge.join(oe, ["p", "q"]).groupBy("gap", "_g").agg(F.sum(size).alias("n")).groupBy("gap").agg(F.min_by("_g", F.struct(-F.col("n"), F.col("_g"))).alias("_g"))
        owned = owned.unionByName(free.join(best, "gap").select("_g", GEOM))
    pieces = with_fid(owned, shuffled=True)
    merged = outlines(edges(Layer(pieces.select(FID, GEOM), "", "polygon")).join(pieces.select(FID, "_g"), FID))
    out = layer.df.drop(GEOM).join(merged, layer.df[FID] == merged["_g"], "left").drop("_g")
    return layer.with_df(out)


def dissolve_overlapping(layer: Layer, fields: list[str] | None = None, calc: str | None = None, sum_fields: list[str] | None = None, copy_fields: list[str] | None = None, defs: dict | None = None) -> Layer:
    """Polygons of a group become one that covers all they cover; groups may overlap: a tile belongs to every group
    that one of its owners is in."""
    layer.need_geometry("polygon")
    keys = fields or []
    table = dissolve(layer, keys, calc, sum_fields, copy_fields, defs=defs)
    groups = layer.df.groupBy(*keys).agg(F.min(FID).alias("_g"))
    own = layer.df.select(FID, *keys)
    ids = null_safe(own, groups, keys).select(FID, "_g") if keys else own.withColumn("_g", F.lit(groups.first()["_g"]))
    faces = with_fid(tiles(layer.df.select(F.col(FID).alias("id"), GEOM), layer_bounds(layer), _vertices(layer)).where(F.size("owners") > 0), shuffled=True)
    held = faces.select(F.col(FID).alias("_f"), F.explode("owners").alias(FID)).join(ids, FID).select(F.col("_f").alias(FID), "_g").distinct()
    merged = outlines(edges(Layer(faces.select(FID, GEOM), "", "polygon")).join(held, FID))
    return layer.with_df(table.df.join(merged, table.df[FID] == F.col("_g"), "left").drop("_g"))


def flatten(layers: list[Layer], force: bool = False) -> Layer:
    """Layers merged so that later polygons win where they overlap earlier ones."""
    merged = merge_layers(layers, force)
    top = int(merged.df.agg(F.max(FID)).first()[0] or 0)
    flipped = merged.with_df(merged.df.withColumn(FID, F.lit(top) - F.col(FID)))
    out = clean(flipped)
    return out.with_df(out.df.withColumn(FID, F.lit(top) - F.col(FID)))


def inlay(target: Layer, source: Layer) -> Layer:
    """The source in the place of what it covers of the target."""
    return merge_layers([clip(target, source, erase=True), source], force=True, name=target.name)


def check_geometry(layer: Layer) -> int:
    """The number of places where segments cross other than at common vertices, per feature, added up."""
    def count(parts: list) -> list:
        import numpy as np

        a = np.vstack([np.asarray(p, float)[:-1, :2] for p in parts if len(p) > 1] or [np.zeros((0, 2))])
        b = np.vstack([np.asarray(p, float)[1:, :2] for p in parts if len(p) > 1] or [np.zeros((0, 2))])
        if not len(a):
            return [[0.0]]
        before = {tuple(p) for p in S._snapped(np.vstack([a, b])).tolist()}
        sa, sb = S.split_segments(a, b)
        return [[float(len({tuple(p) for p in np.vstack([sa, sb]).tolist()} - before))]]

    out = layer.settled.select(kernel(count, "array<array<double>>")(F.col(GEOM)).alias("n"))
    return int(out.agg(F.sum(F.col("n")[0][0])).first()[0] or 0)


def line_buffer(layer: Layer, radius: float, quad_segments: int = 8) -> Layer:
    """Lines and polygons widened by a distance in the layer's units, with round ends: discs and boxes, merged."""
    is_polygon = layer.geometry_type == "polygon"

    def one(parts: list) -> list:
        tiles_: list = []
        n = 4 * quad_segments
        for p in parts:
            for x, y, *_ in p:
                tiles_.append([[[x + radius * math.cos(-2 * math.pi * i / n), y + radius * math.sin(-2 * math.pi * i / n)] for i in [*range(n), 0]]])
            for (ax, ay, *_), (bx, by, *_) in zip(p, p[1:]):
                d = math.hypot(bx - ax, by - ay)
                if d:
                    ux, uy = -(by - ay) / d * radius, (bx - ax) / d * radius
                    ring = [[ax + ux, ay + uy], [bx + ux, by + uy], [bx - ux, by - uy], [ax - ux, ay - uy], [ax + ux, ay + uy]]
                    tiles_.append([ring if S.ring_area(ring) > 0 else ring[::-1]])
        if is_polygon:
            tiles_.append(parts)
        return S.merged([t for t, held in S.mosaic(tiles_) if held])

    out = changed(layer, one)
    return out.with_df(out.df, geometry_type="polygon")
