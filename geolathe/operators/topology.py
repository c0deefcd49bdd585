"""Commands on what features share: borders, neighbours, dissolved polygons, filling, colouring and clustering.

Borders are found by an aggregation of undirected edges on their coordinates; only what is left of a group's edges is
chained into rings, in one task per group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolathe.functions import geometry as G
from geolathe.functions import shapes as S
from geolathe.functions.expressions import Value
from geolathe.layer import FID, GEOM, Layer, with_fid
from geolathe.operators.table import dissolve, translator
from geolathe.plans.skew import salted_join
from geolathe.session import written


def edges(layer: Layer) -> DataFrame:
    """A row per segment: fid, ends p and q in a fixed order, and whether the feature runs from p to q."""
    layer.need_geometry("polygon", "polyline")
    xy = lambda c: F.struct(c[0].alias("x"), c[1].alias("y"))
    pairs = F.flatten(F.transform(GEOM, lambda part: F.when(F.size(part) > 1, F.zip_with(F.slice(part, 1, F.size(part) - 1), F.slice(part, 2, F.size(part) - 1), lambda a, b: F.struct(xy(a).alias("a"), xy(b).alias("b")))).otherwise(F.array().cast("array<struct<a:struct<x:double,y:double>,b:struct<x:double,y:double>>>"))))
    df = layer.df.select(FID, F.explode(pairs).alias("e")).where(F.col("e.a") != F.col("e.b"))
    ahead = F.col("e.a") < F.col("e.b")
    return df.select(FID, F.when(ahead, F.col("e.a")).otherwise(F.col("e.b")).alias("p"), F.when(ahead, F.col("e.b")).otherwise(F.col("e.a")).alias("q"), ahead.alias("ahead"))


def borders(layer: Layer) -> DataFrame:
    """(a, b, length) of each two polygons that share segments, in both directions."""
    e = edges(layer).select(FID, "p", "q").distinct()
    left, right = e.withColumnRenamed(FID, "a"), e.withColumnRenamed(FID, "b")
    size = G.distance(F.col("p")["x"], F.col("p")["y"], F.col("q")["x"], F.col("q")["y"], layer.lat_long)
    return left.join(right, ["p", "q"]).where(F.col("a") != F.col("b")).groupBy("a", "b").agg(F.sum(size).alias("length"))


def _lines_of(segs: DataFrame, keys: list[str], types: str) -> DataFrame:
    """Undirected segments chained into lines, per group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        links: dict[tuple, list] = {}
        for p, q in zip(pdf["p"], pdf["q"]):
            p, q = (p["x"], p["y"]), (q["x"], q["y"])
            links.setdefault(p, []).append(q)
            links.setdefault(q, []).append(p)
        lines = []

        def follow(start: tuple) -> list:
            line = [start]
            while links.get(line[-1]):
                q = links[line[-1]].pop()
                links[q].remove(line[-1])
                line.append(q)
                if len(links.get(q, [])) != 1:
                    break
            return line

        for start in sorted(k for k, v in links.items() if len(v) != 2):
            while links.get(start):
                lines.append([list(p) for p in follow(start)])
        for start in sorted(links):
            while links.get(start):
                lines.append([list(p) for p in follow(start)])
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, GEOM: lines}])

    return segs.groupBy(*keys).applyInPandas(run, f"{types}, {GEOM} array<array<array<double>>>")


def innerlines(layer: Layer, where: str | None = None, defs: dict | None = None) -> Layer:
    """The borders between polygons as lines, one feature per pair of neighbours.

    ``where`` tests a pair, its polygons being A and B.
    """
    layer.need_geometry("polygon")
    pairs = _pairs(layer)
    if where:
        pairs = _tested(layer, pairs, where, defs)
    lines = _lines_of(pairs, ["a", "b"], "a bigint, b bigint")
    return layer.with_df(with_fid(lines.orderBy("a", "b").drop("a", "b"), shuffled=True), geometry_type="polyline")


def _pairs(layer: Layer) -> DataFrame:
    """Shared segments with their two polygons, a < b."""
    e = edges(layer).select(FID, "p", "q").distinct()
    return e.withColumnRenamed(FID, "a").join(e.withColumnRenamed(FID, "b"), ["p", "q"]).where(F.col("a") < F.col("b"))


def _tested(layer: Layer, pairs: DataFrame, where: str, defs: dict | None) -> DataFrame:
    kinds = translator(layer).fields
    scope = translator(layer, defs)
    for side, key in (("A", "a"), ("B", "b")):
        fields = layer.df.select(F.col(FID).alias(key), *[F.col(f"`{f}`").alias(f"_{side}_{f}") for f in layer.fields])
        pairs = pairs.join(fields, key, "left")
    scope.others = {side: {f: Value(F.col(f"`_{side}_{f}`"), v.kind, v.item) for f, v in kinds.items()} for side in ("A", "B")}
    return pairs.where(scope.column(where).col).select("p", "q", "a", "b")


def lines(layer: Layer, fields: list[str] | None = None) -> Layer:
    """Polygon borders by rank: ``outer`` (one polygon only), one rank per field whose values differ, then ``inner``.

    RANK counts from 0, TYPE is the name. The fields go from the coarsest to the finest.
    """
    layer.need_geometry("polygon")
    fields = fields or []
    layer.need(*fields)
    vals = layer.df.select(FID, *[F.col(f"`{f}`").cast("string").alias(f"_k{i}") for i, f in enumerate(fields)])
    e = edges(layer).select(FID, "p", "q").distinct().join(vals, FID)
    ranks = e.groupBy("p", "q").agg(F.count(F.lit(1)).alias("n"), *[(F.count_distinct(F.coalesce(f"_k{i}", F.lit(" "))) > 1).alias(f"_d{i}") for i in range(len(fields))])
    rank, kind = F.lit(len(fields) + 1), F.lit("inner")
    for i in range(len(fields) - 1, -1, -1):
        rank, kind = F.when(F.col(f"_d{i}"), i + 1).otherwise(rank), F.when(F.col(f"_d{i}"), fields[i]).otherwise(kind)
    ranks = ranks.select("p", "q", F.when(F.col("n") == 1, 0).otherwise(rank).alias("RANK"), F.when(F.col("n") == 1, "outer").otherwise(kind).alias("TYPE"))
    out = _lines_of(ranks, ["RANK", "TYPE"], "RANK int, TYPE string")
    return layer.with_df(out.withColumn(FID, F.col("RANK").cast("long")), geometry_type="polyline")


def dissolve_polygons(layer: Layer, fields: list[str] | None = None, calc: str | None = None, sum_fields: list[str] | None = None, copy_fields: list[str] | None = None, multipart: bool = False, defs: dict | None = None) -> Layer:
    """Polygons of a group become one: the borders between them cancel, what remains is chained into rings.

    For layers whose polygons meet edge to edge (run ``clean`` first where they overlap). Segments cancel in a
    partial aggregation over (group, segment), so a task that chains rings only sees the outline of its group.
    """
    layer.need_geometry("polygon")
    keys = fields or []
    table = dissolve(layer, keys, calc, sum_fields, copy_fields, defs=defs)
    if multipart:
        ordered = F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col(GEOM).isNotNull(), F.struct(FID, GEOM)))), lambda s: s[GEOM]))
        shapes = layer.df.groupBy(*keys).agg(F.min(FID).alias("_g"), ordered.alias(GEOM))
    else:
        groups = layer.df.groupBy(*keys).agg(F.min(FID).alias("_g"))
        if keys:
            own = layer.df.select(FID, *keys)
            on = [own[k].eqNullSafe(groups[k]) for k in keys]
            cond = on[0]
            for c in on[1:]:
                cond = cond & c
            ids = own.join(groups, cond).select(FID, "_g")
        else:
            first = groups.first()["_g"]
            ids = layer.df.select(FID, F.lit(first).alias("_g"))
        shapes = outlines(edges(layer).join(ids, FID))
    return layer.with_df(table.df.join(shapes.select("_g", GEOM), table.df[FID] == F.col("_g"), "left").drop("_g"))


def outlines(e: DataFrame) -> DataFrame:
    """(_g, geometry) from directed edges of groups ``_g``: an edge run through both ways cancels."""
    left = e.groupBy("_g", "p", "q").agg(F.sum(F.when(F.col("ahead"), 1).otherwise(-1)).alias("n")).where(F.col("n") != 0)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ways: dict[tuple, list] = {}
        for p, q, n in zip(pdf["p"], pdf["q"], pdf["n"]):
            p, q = (p["x"], p["y"]), (q["x"], q["y"])
            if n < 0:
                p, q = q, p
            ways.setdefault(p, []).append(q)
        return pd.DataFrame([{"_g": pdf["_g"].iloc[0], GEOM: S.chained(dict(sorted(ways.items())))}])

    return left.groupBy("_g").applyInPandas(run, f"_g bigint, {GEOM} array<array<array<double>>>")


def dissolve_lines(layer: Layer, fields: list[str] | None = None, calc: str | None = None, defs: dict | None = None) -> Layer:
    """Lines of a group joined at their ends; segments that occur several times are kept once."""
    layer.need_geometry("polyline")
    keys = fields or []
    table = dissolve(layer, keys, calc, defs=defs)
    segs = edges(layer).join(layer.df.select(FID, *keys), FID).select(*keys, "p", "q").distinct()
    types = ", ".join([f"`{k}` {dict(layer.df.dtypes)[k]}" for k in keys] + ["_all int"])
    made = _lines_of(segs.withColumn("_all", F.lit(1)), [*keys, "_all"], types).drop("_all")
    if not keys:  # one row: its values
        row = table.df.first()
        return layer.with_df(made.select(*([F.lit(row[c]).cast(table.df.schema[c].dataType).alias(c) for c in table.df.columns] if row else []), GEOM))
    on = [table.df[k].eqNullSafe(made[k]) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    joined = table.df.join(made, cond, "left")
    for k in keys:
        joined = joined.drop(made[k])
    return layer.with_df(joined)


# --- neighbourhoods ------------------------------------------------------------------------------------------------


def empty(c: Column) -> Column:
    return c.isNull() | (F.trim(c.cast("string")) == "")


def data_fill(layer: Layer, name: str, contiguous: bool = False, weight_field: str | None = None) -> Layer:
    """Fills empty values of polygons from their neighbours, smooths what was filled and, with ``contiguous``, keeps
    only the heaviest connected group of each value (by area, or the sum of a field) and fills the gaps again.

    Round by round from the filled ones inwards, until a round fills nothing: empty polygons whose neighbours hold the
    same set of values get one value, that with the longest common border; ties go to the smaller text. What no
    filled polygon reaches stays.
    """
    layer.need(name, *([weight_field] if weight_field else []))
    shared = written(borders(layer), "borders")
    kind = dict(layer.df.dtypes)[name]
    values = layer.df.select(F.col(FID).alias("a"), F.when(~empty(F.col(f"`{name}`")), F.col(f"`{name}`").cast("string")).alias("v"))
    values = written(values, "fill")
    gaps = values.where(F.col("v").isNull()).select("a")
    values = _smoothed(_filled(values, shared), shared, gaps)
    if contiguous:
        weight = F.col(f"`{weight_field}`").cast("double") if weight_field else G.area(F.col(GEOM), layer.lat_long)
        weights = layer.df.select(F.col(FID).alias("a"), F.coalesce(weight, F.lit(0.0)).alias("w"))
        values = _filled(_largest_groups(values, shared, weights), shared)
    values = values.select(F.col("a").alias("_a"), F.col("v").alias("_v"))
    out = layer.df.join(values, F.col(FID) == F.col("_a"), "left").withColumn(name, F.col("_v").cast(kind)).drop("_a", "_v")
    return layer.with_df(out)


def _votes(shared: DataFrame, of: DataFrame, values: DataFrame) -> DataFrame:
    """(a, v, n): the length of the border of each polygon in ``of`` with those that hold a value."""
    known = values.where(F.col("v").isNotNull()).select(F.col("a").alias("b"), "v")
    return shared.join(of, "a").join(known, "b").groupBy("a", "v").agg(F.sum("length").alias("n"))


def _filled(values: DataFrame, shared: DataFrame) -> DataFrame:
    while True:
        votes = _votes(shared, values.where(F.col("v").isNull()).select("a"), values)
        groups = votes.groupBy("a").agg(F.array_sort(F.collect_list("v")).alias("g"))
        sums = votes.join(groups, "a").groupBy("g", "v").agg(F.sum("n").alias("n"))
        best = sums.groupBy("g").agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("w"))
        found = groups.join(best, "g").select("a", "w")
        new = written(values.join(found, "a", "left").select("a", F.coalesce("v", "w").alias("v"), F.col("w").isNotNull().alias("new")), "fill")
        values = new.select("a", "v")
        if new.where("new").limit(1).count() == 0:
            return values


def _smoothed(values: DataFrame, shared: DataFrame, gaps: DataFrame) -> DataFrame:
    """Polygons that were empty take, in the order of rows, the value with the longest border where that is longer.

    One after the other means: neighbours before a row count with their new values, those after it with their old
    ones. Only one assignment agrees with that, and it is found by repetition until nothing changes.
    """
    pairs = written(shared.join(gaps, "a"), "gaps")
    old, now = values, values
    while True:
        before = pairs.where(F.col("b") < F.col("a")).join(now.withColumnRenamed("a", "b"), "b")
        after = pairs.where(F.col("b") > F.col("a")).join(old.withColumnRenamed("a", "b"), "b")
        votes = before.unionByName(after).where(F.col("v").isNotNull()).groupBy("a", "v").agg(F.sum("length").alias("n"))
        mine = votes.join(old.select("a", F.col("v").alias("_old")), "a")
        top = mine.groupBy("a").agg(F.min_by("v", F.struct(-F.col("n"), F.col("v") != F.col("_old"), F.col("v"))).alias("w"), F.count(F.lit(1)).alias("k")).where("k > 1").select("a", "w")
        new = old.join(top, "a", "left").select("a", F.coalesce("w", "v").alias("v"))
        new = written(new.join(now.withColumnRenamed("v", "_now"), "a").select("a", "v", (~F.col("v").eqNullSafe(F.col("_now"))).alias("new")), "smooth")
        now = new.select("a", "v")
        if new.where("new").limit(1).count() == 0:
            return now


def _largest_groups(values: DataFrame, shared: DataFrame, weights: DataFrame) -> DataFrame:
    """Values only in the heaviest connected group of each, the first one where they weigh the same."""
    from geolathe.operators.classify import components

    held = values.where(F.col("v").isNotNull())
    same = shared.select("a", "b").join(held, "a").join(held.select(F.col("a").alias("b"), F.col("v").alias("_w")), "b").where(F.col("v") == F.col("_w"))
    link = F.concat_ws("-", F.least("a", "b"), F.greatest("a", "b"))
    members = same.groupBy("a").agg(F.collect_list(link).alias("m"))
    parts = components(held.select("a").join(members, "a", "left"), "a", "m")
    sized = parts.join(held, "a").join(weights, "a").groupBy("v", "component").agg(F.sum("w").alias("w"))
    best = sized.groupBy("v").agg(F.min_by("component", F.struct(-F.col("w"), F.col("component"))).alias("component"))
    kept = parts.join(best.select("component"), "component", "left_semi").select("a", F.lit(True).alias("_kept"))
    return written(values.join(kept, "a", "left").select("a", F.when(F.col("_kept"), F.col("v")).alias("v")), "fill")


def coloured(layer: Layer, classes: int = 5) -> DataFrame:
    """(fid, class) such that neighbours differ where ``classes`` allow it: most constrained first.

    The colouring is sequential by nature: the neighbour table (a few pairs a polygon) goes to one task.
    """
    pairs = borders(layer).groupBy("a").agg(F.array_sort(F.collect_list("b")).alias("n"))
    table = layer.df.select(FID).join(pairs, F.col(FID) == F.col("a"), "left").select(FID, "n")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = pd.concat(list(batches), ignore_index=True) if batches else pd.DataFrame()
        if not len(df):
            return
        near = {int(f): [int(v) for v in n] if n is not None else [] for f, n in zip(df[FID], df["n"])}
        colour: dict[int, int] = {}
        used: dict[int, set] = {f: set() for f in near}
        while len(colour) < len(near):
            f = min((x for x in near if x not in colour), key=lambda x: (-len(used[x]), -len(near[x]), x))
            counts = [sum(1 for y in near[f] if colour.get(y) == c) for c in range(classes)]
            colour[f] = counts.index(min(counts))
            for y in near[f]:
                used[y].add(colour[f])
        yield pd.DataFrame({FID: list(colour), "class": list(colour.values())})

    return table.coalesce(1).mapInPandas(run, f"{FID} bigint, class int")


def cluster(layer: Layer, pct: float | None = None, max_width: float | None = None, max_height: float | None = None, max_area: float | None = None, group_by: str | None = None) -> Layer:
    """Merges neighbouring polygons greedily by distance of centroids within size limits; writes ``cluster``.

    A group is one task (a greedy merge is sequential); groups run in parallel. ``pct`` bounds the clusters' number
    as a share of the polygons.
    """
    g = F.col(GEOM)
    cx, cy = G.centroid(g)
    b = G.bounds(g, False)
    key = F.col(f"`{group_by}`").cast("string") if group_by else F.lit("")
    near = borders(layer).groupBy("a").agg(F.collect_list("b").alias("n"))
    items = layer.df.select(FID, F.coalesce(key, F.lit("")).alias("k"), cx.alias("cx"), cy.alias("cy"), G.area(g).alias("area"), *[b[n].alias(n) for n in ("xmin", "ymin", "xmax", "ymax")])
    items = items.join(near, F.col(FID) == F.col("a"), "left").drop("a")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import heapq

        pdf = pdf.sort_values(FID)
        state = {int(r[FID]): [r["cx"], r["cy"], r["area"], r["xmin"], r["ymin"], r["xmax"], r["ymax"], {int(r[FID])}, {int(v) for v in r["n"]} if r["n"] is not None else set()] for _, r in pdf.iterrows()}
        here = set(state)
        for s in state.values():
            s[8] &= here
        version = {f: 0 for f in state}
        heap: list = []

        def offer(a: int, c: int) -> None:
            s, t = state[a], state[c]
            heapq.heappush(heap, (math.hypot(s[0] - t[0], s[1] - t[1]), min(a, c), max(a, c), version[min(a, c)], version[max(a, c)]))

        for a in state:
            for c in state[a][8]:
                if a < c:
                    offer(a, c)
        goal = max(1, math.ceil(len(state) * pct)) if pct else 1
        while heap and len(state) > goal:
            _, a, c, va, vc = heapq.heappop(heap)
            if a not in state or c not in state or version[a] != va or version[c] != vc:
                continue
            s, t = state[a], state[c]
            box = [min(s[3], t[3]), min(s[4], t[4]), max(s[5], t[5]), max(s[6], t[6])]
            area = s[2] + t[2]
            if (max_width and box[2] - box[0] > max_width) or (max_height and box[3] - box[1] > max_height) or (max_area and area > max_area):
                continue
            w = [(s[i] * s[2] + t[i] * t[2]) / area if area else s[i] for i in (0, 1)]
            state[a] = [*w, area, *box, s[7] | t[7], (s[8] | t[8]) - {a, c}]
            del state[c]
            version[a] += 1
            for n in state[a][8]:
                if n in state:
                    state[n][8].discard(c)
                    state[n][8].add(a)
                    offer(a, n)
        rows = [(f, i) for i, (_, s) in enumerate(sorted(state.items())) for f in s[7]]
        return pd.DataFrame(rows, columns=[FID, "cluster"])

    made = items.groupBy("k").applyInPandas(run, f"{FID} bigint, cluster int")
    return layer.with_df(layer.df.join(made, FID, "left"))


#: Cells along an interval: points of one cell or of two that touch are never farther apart than it. Cells along a block.
FINE, BLOCK = 3, 12


def alpha_shapes(layer: Layer, interval: float) -> Layer:
    """Polygons around points that are near each other: Delaunay triangles with no side above the interval, merged.

    Points farther apart than the interval never share a triangle that counts, so groups linked by shorter distances
    are triangulated one by one, in parallel.
    """
    layer.need_geometry("point")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pts = sorted(zip(pdf["x"].tolist(), pdf["y"].tolist()))
        tiles = []
        for t in S.delaunay([list(p) for p in pts]):
            ring = [list(pts[i]) for i in (*t, t[0])]
            if max(S.hop(a, b, False) for a, b in zip(ring, ring[1:])) <= interval:
                tiles.append([ring if S.ring_area(ring) > 0 else ring[::-1]])
        return pd.DataFrame([{FID: int(pdf["g"].iloc[0]), GEOM: S.merged(tiles) if tiles else None}])

    shapes = _linked(_placed(layer), interval).groupBy("g").applyInPandas(run, f"{FID} bigint, {GEOM} array<array<array<double>>>")
    return layer.with_df(shapes.where(F.col(GEOM).isNotNull()), geometry_type="polygon")


def filter_points(layer: Layer, interval: float) -> Layer:
    """Points that belong to a Delaunay triangle with all sides up to the interval."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pts = sorted(zip(pdf["x"].tolist(), pdf["y"].tolist()))
        keep = set()
        for t in S.delaunay([list(p) for p in pts]):
            if max(S.hop(list(pts[a]), list(pts[b]), False) for a, b in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0]))) <= interval:
                keep |= {pts[i] for i in t}
        return pd.DataFrame(sorted(keep), columns=["x", "y"], dtype=float)

    points = _placed(layer)
    places = _linked(points, interval).groupBy("g").applyInPandas(run, "x double, y double")
    kept = salted_join(points, places, ["x", "y"], F.col(FID), "inner").select(FID)
    return layer.with_df(layer.df.join(kept, FID, "left_semi"))


def _placed(layer: Layer) -> DataFrame:
    """(fid, x, y) of the points with finite coordinates; the others are in no triangle."""
    pts = layer.df.where(F.size(GEOM) > 0).select(FID, F.get(GEOM, F.lit(0))[0].alias("x"), F.get(GEOM, F.lit(0))[1].alias("y"))
    return pts.where((F.abs("x") < math.inf) & (F.abs("y") < math.inf))


def _linked(points: DataFrame, interval: float) -> DataFrame:
    """Places (x, y), points at one place being one, with ``g``: the group linked by steps of at most the interval, named
    by its least fid.

    Pairs of points grow with the square of the points in reach, so the links are between cells, a few each: those
    that touch are linked whatever they hold. What that leaves apart is linked by the distances of places, tried only
    between cells of different groups.
    """
    side, most = interval / FINE, F.lit(float(interval) ** 2)
    cell = lambda c: F.floor(F.col(c) / side).cast("double").alias(f"_{c}")
    places = written(points.groupBy("x", "y").agg(F.min(FID).alias("id")).select("id", "x", "y", cell("x"), cell("y")), "places")
    box = [f(c).alias(f"{c}{n}") for c in ("x", "y") for n, f in enumerate((F.min, F.max))]
    cells = written(places.groupBy("_x", "_y").agg(F.min("id").alias("id"), *box), "cells")

    touching = _meeting(cells, 1).where((F.abs(F.col("a._x") - F.col("b._x")) <= 1) & (F.abs(F.col("a._y") - F.col("b._y")) <= 1))
    groups = _chained(cells.select("id"), touching.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")))
    cells = written(cells.join(groups, "id"), "cells")

    gap = lambda c: F.greatest(F.lit(0.0), F.col(f"a.{c}0") - F.col(f"b.{c}1"), F.col(f"b.{c}0") - F.col(f"a.{c}1"))
    span = lambda c: F.greatest(F.col(f"a.{c}1") - F.col(f"b.{c}0"), F.col(f"b.{c}1") - F.col(f"a.{c}0"))
    apart = _meeting(cells, FINE + 1).where((F.col("a.g") != F.col("b.g")) & (gap("x") * gap("x") + gap("y") * gap("y") <= most))
    sure = (span("x") * span("x") + span("y") * span("y") <= most).alias("sure")
    apart = written(apart.select(sure, F.struct("a.*").alias("a"), F.struct("b.*").alias("b")), "apart")
    if apart.limit(1).count():
        ends = [F.least("a.g", "b.g").alias("a"), F.greatest("a.g", "b.g").alias("b")]
        links = apart.where("sure").select(*ends).unionByName(_close(apart.where("not sure"), places, most).select(*ends)).distinct()
        groups = _chained(cells.select(F.col("g").alias("id")).distinct(), links)
        cells = cells.join(groups.withColumnRenamed("id", "_g").withColumnRenamed("g", "_to"), F.col("g") == F.col("_g")).withColumn("g", F.col("_to"))
    return places.select("x", "y", "_x", "_y").join(cells.select("_x", "_y", "g"), ["_x", "_y"]).select("x", "y", "g")


def _meeting(cells: DataFrame, reach: int) -> DataFrame:
    """Pairs of cells ``a`` and ``b`` in blocks that ``reach`` cells around b touch; each pair once."""
    block = lambda c, by=0: F.floor((F.col(f"_{c}") + by) / BLOCK).cast("long")
    visits = cells.withColumn("bx", F.explode(F.sequence(block("x", -reach), block("x", reach)))).withColumn("by", F.explode(F.sequence(block("y", -reach), block("y", reach))))
    a = cells.select(block("x").alias("bx"), block("y").alias("by"), F.struct(*cells.columns).alias("a"))
    b = visits.select("bx", "by", F.struct(*cells.columns).alias("b"))
    return a.join(b, ["bx", "by"]).where(F.col("a.id") < F.col("b.id")).select("a", "b")


def _close(pairs: DataFrame, places: DataFrame, most: Column) -> DataFrame:
    """Pairs of cells that hold places at most the interval apart, its square being ``most``."""

    def held(df: DataFrame, side: str, other: str) -> DataFrame:
        """Rows with the places of a cell as near to the other cell's box."""
        own = places.select(F.struct("_x", "_y").alias("_cell"), F.struct("x", "y").alias(f"p{side}"))
        far = lambda c: F.greatest(F.lit(0.0), F.col(f"{other}.{c}0") - F.col(f"p{side}.{c}"), F.col(f"p{side}.{c}") - F.col(f"{other}.{c}1"))
        return df.join(own, F.struct(F.col(f"{side}._x").alias("_x"), F.col(f"{side}._y").alias("_y")) == F.col("_cell")).drop("_cell").where(far("x") * far("x") + far("y") * far("y") <= most)

    dx, dy = F.col("pa.x") - F.col("pb.x"), F.col("pa.y") - F.col("pb.y")
    return held(held(pairs, "a", "b"), "b", "a").where(dx * dx + dy * dy <= most)


def _chained(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, g): nodes linked directly or through others, ``g`` being their least id. Links (a, b) have a < b."""
    from geolathe.operators.classify import components

    members = nodes.select("id", F.array("id").alias("m")).unionByName(links.select(F.col("b").alias("id"), F.array("a").alias("m")))
    return components(members, "id", "m").withColumnRenamed("component", "g")
