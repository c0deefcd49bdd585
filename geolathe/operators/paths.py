"""Per-feature geometry commands on lines and polygons. Kernels run on Arrow batches of the geometry column alone."""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolathe.functions import geometry as G
from geolathe.functions import shapes as S
from geolathe.layer import FID, GEOM, Layer, LayerError, with_fid
from geolathe.operators.classify import ranked_values
from geolathe.operators.table import layer_bounds, strict
from geolathe.plans.skew import salted_join
from geolathe.session import written

PATH, POINT = "array<array<array<double>>>", "array<array<double>>"
ARROW = {
    PATH: pa.list_(pa.list_(pa.list_(pa.float64()))),
    POINT: pa.list_(pa.list_(pa.float64())),
    "array<array<array<array<double>>>>": pa.list_(pa.list_(pa.list_(pa.list_(pa.float64())))),
}


def kernel(f: Callable, returns: str = PATH) -> Callable[..., Column]:
    """A function of geometries (lists) as a column function; null in gives null out."""

    @F.arrow_udf(returns)
    def run(*arrays: pa.Array) -> pa.Array:
        rows = zip(*[a.to_pylist() for a in arrays])
        return pa.array([None if r[0] is None else f(*r) for r in rows], type=ARROW[returns])

    return run


def moved(layer: Layer, f: Callable) -> Layer:
    """The layer with ``f(x, y)``, a function of arrays, applied to all coordinates: one call for a batch of features.

    Parts with a coordinate that ``f`` can't place (not finite) are dropped, and features left without parts null.
    """
    point = layer.geometry_type == "point"
    kind = POINT if point else PATH

    @F.arrow_udf(kind)
    def run(g: pa.Array) -> pa.Array:
        g = g if isinstance(g, pa.Array) else g.combine_chunks()
        levels, at = [], pa.concat_arrays([g])
        while pa.types.is_list(at.type):
            levels.append(at)
            at = at.values
        xy = at.to_numpy(zero_copy_only=False).copy()
        first = levels[-1].offsets.to_numpy()[:-1]
        first = first[~levels[-1].is_null().to_numpy(zero_copy_only=False)]
        xy[first], xy[first + 1] = f(xy[first], xy[first + 1])
        new: pa.Array = pa.array(xy)
        for level in reversed(levels):
            new = pa.ListArray.from_arrays(level.offsets, new, mask=level.is_null())
        return new.cast(ARROW[kind])

    made = layer.settled.withColumn(GEOM, run(F.col(GEOM)))
    finite = lambda p: ~(F.isnan(p[0]) | F.isnan(p[1]) | (F.abs(p[0]) == float("inf")) | (F.abs(p[1]) == float("inf")))
    kept = F.filter(GEOM, finite if point else lambda part: F.forall(part, finite))
    return layer.with_df(made.withColumn(GEOM, kept).withColumn(GEOM, F.when(F.size(GEOM) > 0, F.col(GEOM))))


def changed(layer: Layer, f: Callable[[list], list], where: str | None = None, defs: dict | None = None, empty_null: bool = True) -> Layer:
    """The layer with ``f`` applied to each feature's parts; features left without parts become null."""
    layer.need_geometry("polyline", "polygon")
    new = kernel(lambda parts: f(parts) or (None if empty_null else []))(F.col(GEOM))
    return layer.with_df(layer.settled.withColumn(GEOM, F.when(strict(layer, where, defs), new).otherwise(F.col(GEOM)) if where else new))


def explode(layer: Layer, naive: bool = False) -> Layer:
    """A row per part: points and lines one by one, rings with their holes (``naive``: every ring by itself).

    Rows keep their order; features without parts stay as they are.
    """
    if layer.geometry_type is None:
        raise LayerError("a table has no parts")
    g = F.col(GEOM)
    if layer.geometry_type == "polygon" and not naive:
        groups = kernel(S.nested, "array<array<array<array<double>>>>")(g)
    else:
        groups = F.transform(g, lambda p: F.array(p))
    rows = layer.settled.select(F.col(FID), F.posexplode_outer(groups).alias("_i", "_part"), *[F.col(f"`{f}`") for f in layer.fields])
    out = with_fid(rows.withColumn(GEOM, F.col("_part")).orderBy(FID, "_i").drop(FID, "_i", "_part"), shuffled=True)
    return layer.with_df(out)


def inner_point_layer(layer: Layer) -> Layer:
    layer.need_geometry("polygon")

    def run(parts: list) -> list | None:
        p = S.inner_point(parts)
        return [p] if p else None

    return layer.with_df(layer.settled.withColumn(GEOM, kernel(run, POINT)(F.col(GEOM))), geometry_type="point")


def line_points(layer: Layer, how: str, interval: float | None = None) -> Layer:
    """Points of lines: ``midpoints`` (one per part), ``interpolated`` (every interval) or ``central`` (one per feature)."""
    layer.need_geometry("polyline", "polygon")
    sphere = layer.lat_long

    def midpoints(parts: list) -> list:
        return [S.along(p, S.line_length(p) / 2) for p in parts if len(p) > 1]

    def spaced(parts: list) -> list:
        out = []
        for p in parts:
            n = int(S.line_length(p, sphere) / (interval or 1) + 1e-9)
            out += [S.along(p, i * (interval or 1), sphere) for i in range(n + 1)]
            if p[0] != p[-1] and S.hop(out[-1], p[-1], sphere) > 1e-9:
                out.append(p[-1])
        return out

    def central(parts: list) -> list | None:
        if not parts:
            return None
        longest = max(parts, key=S.line_length)
        xs, ys = [p[0] for p in longest], [p[1] for p in longest]
        c = [(min(xs) + max(xs)) / 2, (min(ys) + max(ys)) / 2]
        return [min(longest, key=lambda p: S.hop(p, c, False))]

    f = {"midpoints": midpoints, "interpolated": spaced, "central": central}[how]
    return layer.with_df(layer.settled.withColumn(GEOM, kernel(f, POINT)(F.col(GEOM))), geometry_type="point")


def segments(layer: Layer) -> Layer:
    """A line for every segment, with its feature's fields."""
    layer.need_geometry("polyline", "polygon")
    pairs = F.flatten(F.transform(GEOM, lambda part: F.when(F.size(part) > 1, F.zip_with(F.slice(part, 1, F.size(part) - 1), F.slice(part, 2, F.size(part) - 1), lambda a, b: F.array(a, b))).otherwise(F.array().cast(PATH))))
    rows = layer.df.select(F.col(FID), F.posexplode(pairs).alias("_i", "_s"), *[F.col(f"`{f}`") for f in layer.fields])
    return layer.with_df(with_fid(rows.withColumn(GEOM, F.array("_s")).orderBy(FID, "_i").drop(FID, "_i", "_s"), shuffled=True), geometry_type="polyline")


def lines_from_points(layer: Layer, group_by: str | None = None) -> Layer:
    """A line through the points of each group, in row order; groups of one point have no line."""
    layer.need_geometry("point")
    keys = [group_by] if group_by else []
    ordered = F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col(GEOM).isNotNull(), F.struct(FID, GEOM)))), lambda s: s[GEOM]))
    out = layer.df.groupBy(*keys).agg(F.min(FID).alias(FID), ordered.alias("_p"))
    return layer.with_df(out.withColumn(GEOM, F.when(F.size("_p") > 1, F.array("_p"))).drop("_p"), geometry_type="polyline")


# --- simplification ------------------------------------------------------------------------------------------------


def node_flags(layer: Layer) -> DataFrame:
    """fid and, for every part, which of its vertices are nodes: vertices where not exactly two edges meet.

    Edges are counted across all features, so neighbouring polygons get the same nodes on their common border: the
    only step of simplification that looks beyond a feature, and an ordinary aggregation on coordinates.
    """
    parts = layer.df.select(FID, F.posexplode(GEOM).alias("_p", "_part"))
    point = parts.select(FID, "_p", F.posexplode("_part").alias("_i", "_xy"), F.col("_part"))
    xy = lambda c: F.struct(c[0].alias("x"), c[1].alias("y"))
    n = F.size("_part")
    ring = (n > 3) & (F.get("_part", F.lit(0)) == F.element_at("_part", -1))
    before = F.when(F.col("_i") > 0, F.get("_part", F.col("_i") - 1)).when(ring, F.get("_part", n - 2))
    after = F.when(F.col("_i") < n - 1, F.get("_part", F.col("_i") + 1)).when(ring, F.get("_part", F.lit(1)))
    links = point.select(xy(F.col("_xy")).alias("k"), F.explode(F.array(before, after)).alias("_o")).where(F.col("_o").isNotNull())
    degree = links.select("k", xy(F.col("_o")).alias("o")).distinct().groupBy("k").agg(F.count(F.lit(1)).alias("d"))
    flagged = point.select(FID, "_p", "_i", xy(F.col("_xy")).alias("k")).join(degree, "k", "left").select(FID, "_p", "_i", (F.coalesce("d", F.lit(0)) != 2).alias("f"))
    per_part = flagged.groupBy(FID, "_p").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "f"))), lambda s: s["f"]).alias("f"))
    return per_part.groupBy(FID).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "f"))), lambda s: s["f"]).alias("_nodes"))


def simplify(layer: Layer, percentage: float | None = None, interval: float | None = None, resolution: float | None = None, method: str = "weighted", weighting: float = 0.7, planar: bool = False, keep_shapes: bool = False, topology: bool = True) -> Layer:
    """Drops vertices: Douglas-Peucker (``dp``), Visvalingam (``visvalingam``) or its weighted form.

    Each vertex gets a threshold; ``percentage`` keeps that share of the removable vertices of the whole layer (their
    rank is found from a bracket around it), ``interval`` keeps vertices above a size, ``resolution`` (pixels across the
    longer side) half a pixel. Lines are cut at nodes first, so borders between polygons stay common. Rings that
    collapse are dropped, or kept in their smallest form with ``keep_shapes``.
    """
    layer.need_geometry("polyline", "polygon")
    sphere = layer.lat_long and not planar

    def thresholds(arc: list) -> list[float]:
        return S.dp_thresholds(arc, sphere) if method == "dp" else S.visvalingam_thresholds(arc, weighting if method == "weighted" else 0.0, sphere)

    def weighed(parts: list, nodes: list) -> list:
        """The parts from a node on, each vertex with its threshold; ends of arcs have none that removes them."""
        out = []
        for p, n in zip(parts, nodes):
            ring: list = []
            for arc in S.split_at(p, n):
                flip = arc[-1] < arc[0] or (arc[0] == arc[-1] and len(arc) > 3 and arc[-2] < arc[1])
                arc = arc[::-1] if flip else arc
                new = [[*map(float, q[:2]), t] for q, t in zip(arc, thresholds(arc))]
                new = new[::-1] if flip else new
                ring += new if not ring else new[1:]
            out.append(ring)
        return out

    df = layer.settled
    df = df.join(node_flags(layer), FID, "left") if topology else df.withColumn("_nodes", F.transform(GEOM, lambda p: F.transform(p, lambda q: F.lit(False))))
    df = written(df.withColumn("_w", kernel(weighed)(F.col(GEOM), F.col("_nodes"))).drop("_nodes"), "thresholds")
    if resolution:
        b = layer_bounds(layer) or [0, 0, 0, 0]
        interval = 0.5 * max(b[2] - b[0], b[3] - b[1]) / resolution
        if sphere:
            interval *= math.radians(1) * S.RADIUS
    if percentage is not None:
        # a vertex that neighbours share is one
        marked = df.select(F.explode(F.flatten("_w")).alias("m")).where(F.col("m")[2] < float("inf")).distinct()
        vals = marked.select(F.col("m")[2].alias("v"))
        n = vals.count()
        rank = min(n, math.floor((1 - percentage) * n + 1e-9))
        interval = (ranked_values(vals, [rank], n)[0] if rank < n else math.inf) if n else 0.0
    limit = F.lit(float(interval or 0.0))

    def kept(part: Column) -> Column:
        new = F.transform(F.filter(part, lambda q: q[2] >= limit), lambda q: F.array(q[0], q[1]))
        return F.when((F.size(new) > 3) & (G.ring_area(new) * G.ring_area(part) > 0), new) if layer.geometry_type == "polygon" else new

    new = F.array_compact(F.transform("_w", kept))
    out = layer.with_df(df.withColumn("_new", F.when(F.size(new) > 0, new)).drop("_w"))
    if not keep_shapes:
        return out.with_df(out.df.withColumn(GEOM, F.col("_new")).drop("_new"))

    def smallest(parts: list) -> list | None:
        if not parts:
            return None
        big = max(parts, key=lambda r: abs(S.ring_area(r)))
        t = S.visvalingam_thresholds(big, 0.0, sphere)
        order = sorted(range(1, len(big) - 1), key=lambda i: -t[i])[:2]
        return [[big[0], *[big[i] for i in sorted(order)], big[-1]]]

    lost = kernel(smallest)(F.when(F.col("_new").isNull(), F.col(GEOM)))
    return out.with_df(out.df.withColumn(GEOM, F.coalesce("_new", lost)).drop("_new"))


def densify(layer: Layer, interval: float, planar: bool = False) -> Layer:
    sphere = layer.lat_long and not planar
    return changed(layer, lambda parts: [S.densified(p, interval, sphere) for p in parts])


def dashlines(layer: Layer, dash: float, gap: float = 0.0, scaled: bool = False, planar: bool = False, where: str | None = None, defs: dict | None = None) -> Layer:
    layer.need_geometry("polyline")
    sphere = layer.lat_long and not planar
    return changed(layer, lambda parts: [d for p in parts for d in S.dashes(p, dash, gap, scaled, sphere)], where, defs)


def smooth(layer: Layer, distance: float, planar: bool = False) -> Layer:
    sphere = layer.lat_long and not planar
    return changed(layer, lambda parts: [S.smoothed(p, distance, sphere) for p in parts])


# --- rings ---------------------------------------------------------------------------------------------------------


def filter_islands(layer: Layer, min_area: float = 0.0, min_vertices: int = 0, remove_empty: bool = False) -> Layer:
    """Drops detached rings (with their holes) below an area or a number of vertices."""
    layer.need_geometry("polygon")

    def run(parts: list) -> list:
        return [r for g in S.nested(parts) if S.ring_area(g[0]) >= min_area and len(g[0]) - 1 >= min_vertices for r in g]

    out = changed(layer, run)
    return out.with_df(out.df.where(F.col(GEOM).isNotNull())) if remove_empty else out


def sliver_threshold(layer: Layer) -> float:
    """Area below which a ring is a sliver, from the mean length of segments and their number per ring."""
    g = F.col(GEOM)
    per = layer.df.select(G.length(g).alias("len"), G.over_parts(g, lambda p: (F.size(p) - 1).cast("double")).alias("n"), F.size(g).alias("rings"))
    r = per.agg(F.sum("len"), F.sum("n"), F.sum("rings")).first()
    if not r[1]:
        return 0.0
    value = (r[0] / r[1]) ** 2 / 50 * (r[1] / r[2]) ** 0.75
    return float(f"{value:.1e}") if value else 0.0


def filter_slivers(layer: Layer, min_area: float | None = None, sliver_control: float = 1.0, remove_empty: bool = False) -> Layer:
    """Drops rings whose area, reduced by how far they are from compact, is below the threshold."""
    layer.need_geometry("polygon")
    limit = sliver_threshold(layer) if min_area is None else min_area
    k = math.sqrt(sliver_control)

    def wide(r: list) -> bool:
        area, length = abs(S.ring_area(r)), S.line_length(r)
        compact = 4 * math.pi * area / (length * length) if length else 0.0
        return area * (k * compact + 1 - k) >= limit

    out = changed(layer, lambda parts: [r for r in parts if wide(r)])
    return out.with_df(out.df.where(F.col(GEOM).isNotNull())) if remove_empty else out


def filter_detail(layer: Layer, distance: float) -> Layer:
    """Drops bends that leave and return within the distance: vertices between two places nearer than the way round."""

    def run(part: list) -> list:
        out = list(part)
        i = 0
        while i < len(out) - 2:
            way, best = 0.0, None
            for j in range(i + 1, len(out)):
                way += S.hop(out[j - 1], out[j], False)
                if way > 4 * distance:
                    break
                if j > i + 1 and S.hop(out[i], out[j], False) < distance and way > 2 * S.hop(out[i], out[j], False) and j < len(out) - 1:
                    best = j
            if best:
                del out[i + 1 : best]
            i += 1
        return out if len(out) > (3 if part[0] == part[-1] else 1) else part

    return changed(layer, lambda parts: [run(p) for p in parts])


def clip_bbox(layer: Layer, bbox: list[float], erase: bool = False) -> Layer:
    """Lines and polygons cut to a box (or what of them is outside), row by row."""
    box = tuple(map(float, bbox))
    if layer.geometry_type == "polyline":
        out = changed(layer, lambda parts: [q for p in parts for q in S.clip_line(p, box, erase)])
    elif erase:
        x0, y0, x1, y1 = box
        ring = [[[x0, y0], [x0, y1], [x1, y1], [x1, y0], [x0, y0]]]
        out = changed(layer, lambda parts: S.clipped(parts, [ring], True))
    else:
        out = changed(layer, lambda parts: [q for p in parts if (q := S.clip_ring(p, box))])
    return out.with_df(out.df.where(F.col(GEOM).isNotNull()))


def snap(layer: Layer, interval: float | None = None) -> Layer:
    """Vertices within the interval of each other become one: the first of them by x, then y.

    Vertices linked by steps of at most the interval are one group. Without an interval only differences in the last
    digits of doubles are taken out. Points that fall together within a part become one; parts left too short go.
    """
    from geolathe.operators.classify import components
    from geolathe.operators.proximity import near_planar

    layer.need_geometry("polyline", "polygon")
    if not interval:
        b = layer_bounds(layer)
        interval = max(map(abs, b)) * 2.0**-51 if b else 0.0
    least = 4 if layer.geometry_type == "polygon" else 2
    points = layer.df.select(FID, F.posexplode(GEOM).alias("_p", "_part")).select(FID, "_p", F.posexplode("_part").alias("_i", "_xy"))
    points = written(points.select(FID, "_p", "_i", F.col("_xy")[0].alias("x"), F.col("_xy")[1].alias("y")), "vertices")
    places = with_fid(points.groupBy("x", "y").count().orderBy("x", "y").select("x", "y"), shuffled=True).withColumnRenamed(FID, "id")
    near = near_planar(places, "id", "x", "y", interval)
    link = F.concat_ws("-", "id_lo", "id_hi")
    members = near.select(F.col("id_lo").alias("id"), link.alias("m")).unionByName(near.select(F.col("id_hi").alias("id"), link.alias("m"))).groupBy("id").agg(F.collect_list("m").alias("m"))
    first = places.select(F.col("id").alias("component"), F.col("x").alias("_sx"), F.col("y").alias("_sy"))
    linked = components(members, "id", "m").where(F.col("component") != F.col("id")).join(first, "component").join(places, "id").select("x", "y", "_sx", "_sy")
    snapped = salted_join(points, linked, ["x", "y"], F.col(FID)).select(FID, "_p", "_i", F.array(F.coalesce("_sx", "x"), F.coalesce("_sy", "y")).alias("_xy"))
    parts = snapped.groupBy(FID, "_p").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_xy"))), lambda s: s["_xy"]).alias("_part"))
    made = parts.groupBy(FID).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_part"))), lambda s: s["_part"]).alias("_made"))
    merged = F.transform("_made", lambda part: F.filter(part, lambda p, i: (i == 0) | (p != F.get(part, i - 1))))
    kept = F.filter(merged, lambda part: F.size(part) >= least)
    out = layer.df.join(made, FID, "left").withColumn(GEOM, F.when(F.size(kept) > 0, kept)).drop("_made")
    return layer.with_df(out)
