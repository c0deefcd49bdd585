"""Joins that keep every target row: by key, by position, by overlap; all end in one step over matched pairs.

A match is a DataFrame of pairs (``_t``: target row, ``_s``: source row). The target keeps its rows and order; copied
fields come from the first match in source order, ``calc`` runs over all matches, ``duplication`` repeats target rows.
Joins by key make no pairs unless a result asks for them: the source is reduced to one row per key first.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geolathe.functions import geometry as G
from geolathe.functions.aggregates import Plan, compiled, grouped
from geolathe.functions.expressions import BOOL, NUM, ExpressionError, Translator, Value, parse, plain_number, walk
from geolathe.layer import FID, GEOM, Layer, LayerError, with_fid
from geolathe.operators.proximity import containing, near_pairs_between
from geolathe.operators.table import translator
from geolathe.plans.skew import salted_join


@dataclass
class JoinOptions:
    """Options of a join; see the functions that read them."""

    fields: list[str] | None = None
    calc: str | None = None
    where: str | None = None
    prefix: str = ""
    force: bool = False
    duplication: bool = False
    sum_fields: list[str] = field(default_factory=list)
    defs: dict = field(default_factory=dict)


@dataclass
class Joined:
    """The target with joined fields, and the rows of either side without a match (anti joins)."""

    layer: Layer
    unjoined: DataFrame
    unmatched: DataFrame


# --- matches -------------------------------------------------------------------------------------------------------


def _kind(layer: Layer, name: str) -> str:
    value = translator(layer).fields[name]
    if value.kind not in (NUM, "string"):
        raise LayerError(f"{name} can't be a join key: {value.kind}")
    return value.kind


#: A key in two columns that are never null: whether it is null, and its value.
KEY = ["_kn", "_kv"]


def _keyed(df: DataFrame, name: str, cast: str) -> DataFrame:
    key = F.col(f"`{name}`").cast(cast)
    return df.withColumns({"_kn": key.isNull(), "_kv": F.coalesce(key, F.lit(0.0 if cast == "double" else ""))})


def checked_keys(target: Layer, source: Layer, target_key: str, source_key: str) -> tuple[DataFrame, DataFrame]:
    """Both tables with their key in two columns. Keys must be both texts or both numbers.

    A key column without any value is an error, unless its layer has no rows.
    """
    target.need(target_key)
    source.need(source_key)
    kinds = _kind(target, target_key), _kind(source, source_key)
    for layer, name in ((target, target_key), (source, source_key)):
        if layer.df.where(F.col(f"`{name}`").isNotNull()).isEmpty() and not layer.df.isEmpty():
            raise LayerError(f"join key {name} has no values")
    if kinds[0] != kinds[1]:
        raise LayerError(f"join keys of different types: {target_key} is {kinds[0]}, {source_key} is {kinds[1]}")
    cast = "double" if kinds[0] == NUM else "string"
    return _keyed(target.df, target_key, cast), _keyed(source.df, source_key, cast)


def key_matches(target: Layer, source: Layer, target_key: str, source_key: str) -> DataFrame:
    """All pairs with equal keys, for results that have a row per pair; null keys match each other, hot keys are salted."""
    t, s = checked_keys(target, source, target_key, source_key)
    return salted_join(t.select(F.col(FID).alias("_t"), *KEY), s.select(F.col(FID).alias("_s"), *KEY), KEY, F.col("_t"), "inner").select("_t", "_s")


def _first_points(layer: Layer) -> DataFrame:
    """The first point of each point feature."""
    p = F.get(F.col(GEOM), F.lit(0))
    return layer.df.select(FID, p[0].alias("_x"), p[1].alias("_y"))


def _regions(layer: Layer) -> DataFrame:
    """Polygons as one polygon of all rings: rings count by even and odd."""
    return layer.df.select(F.col(FID).alias("_r"), F.when(F.col(GEOM).isNotNull(), F.array(F.col(GEOM))).alias("_shape"))


def point_in_polygon(points: Layer, polygons: Layer) -> DataFrame:
    """(point, polygon) pairs; edges count as inside, and of a multipoint only the first point counts."""
    return containing(_first_points(points), FID, "_x", "_y", _regions(polygons), "_r", "_shape")


def spatial_matches(target: Layer, source: Layer, max_distance: float | None = None, point_method: bool = False, planar: bool = False, largest_overlap: bool = False, min_overlap_pct: float = 0.0, min_overlap_area: float = 0.0) -> DataFrame:
    """Pairs by position, by the geometry types of the two layers."""
    if target.crs and source.crs and target.crs != source.crs:
        raise LayerError("the layers have different coordinate systems")
    kinds = (target.geometry_type, source.geometry_type)
    if kinds == ("point", "polygon"):
        return point_in_polygon(target, source).select(F.col("id").alias("_t"), F.col("region").alias("_s"))
    if kinds == ("polygon", "point"):
        return point_in_polygon(source, target).select(F.col("region").alias("_t"), F.col("id").alias("_s"))
    if kinds == ("point", "point"):
        return near_points(target, source, 0.001 if max_distance is None else max_distance, planar)
    if kinds == ("polygon", "polygon") and not point_method:
        return overlap_matches(target, source, largest_overlap, min_overlap_pct, min_overlap_area)
    if kinds == ("polygon", "polygon"):
        more = target.df.count() > source.df.count()
        inner = inner_points(target if more else source)
        m = point_in_polygon(inner, source if more else target)
        return m.select(F.col("id" if more else "region").alias("_t"), F.col("region" if more else "id").alias("_s"))
    if set(kinds) == {"polyline", "polygon"} and point_method:
        lines, polygons = (target, source) if kinds[0] == "polyline" else (source, target)
        m = point_in_polygon(midpoints(lines), polygons)
        return m.select(F.col("id" if kinds[0] == "polyline" else "region").alias("_t"), F.col("region" if kinds[0] == "polyline" else "id").alias("_s"))
    raise LayerError(f"can't join {kinds[1] or 'a table'} to {kinds[0] or 'a table'} by position")


def near_points(target: Layer, source: Layer, distance: float, planar: bool = False) -> DataFrame:
    """Pairs of points with a part of the target within the distance (metres on the sphere) of one of the source."""
    sphere = (target.lat_long or source.lat_long) and not planar
    parts = [x.df.select(F.col(FID), F.explode(GEOM).alias("_p")).select(FID, F.col("_p")[0].alias("x"), F.col("_p")[1].alias("y")) for x in (target, source)]
    return near_pairs_between(parts[0], parts[1], FID, distance, sphere)


def inner_points(layer: Layer) -> Layer:
    """A point inside of each polygon: of its largest ring."""
    from geolathe.operators.paths import inner_point_layer

    return inner_point_layer(layer)


def midpoints(layer: Layer) -> Layer:
    from geolathe.operators.paths import line_points

    return line_points(layer, "midpoints")


def overlap_matches(target: Layer, source: Layer, largest: bool = False, min_pct: float = 0.0, min_area: float = 0.0) -> DataFrame:
    """Pairs of polygons that share area, with the shared ``area``; of equal largest overlaps the last one wins."""
    from geolathe.operators.overlay import overlap_areas

    pairs = overlap_areas(target, source)
    if min_area:
        pairs = pairs.where(F.col("area") >= min_area)
    if min_pct:
        own = target.df.select(F.col(FID).alias("_t"), F.abs(G.area(F.col(GEOM))).alias("_own"))
        pairs = pairs.join(own, "_t").where(F.col("area") >= F.col("_own") * (min_pct / 100)).drop("_own")
    if largest:
        best = pairs.groupBy("_t").agg(F.max(F.struct("area", "_s")).alias("b"))
        pairs = best.select("_t", F.col("b")["_s"].alias("_s"), F.col("b")["area"].alias("area"))
    return pairs


# --- the one join --------------------------------------------------------------------------------------------------


def tested(df: DataFrame, by: list[str], scope: Translator, where: str, row: Column) -> DataFrame:
    """The rows of ``df`` for which ``where`` holds.

    isMax(x), isMin(x) and isMode(x) compare with all rows of the same ``by``; ties are all kept. What they compare
    with is aggregated and joined back, hot groups being salted by ``row``.
    """
    asked: list[tuple[str, Column]] = []

    def call(kind: str):  # noqa: ANN202
        def run(args: list, tr: Translator) -> Value:
            v = tr.value(args[0])
            if kind == "mode":
                x = F.coalesce(F.concat(F.lit("="), v.col.cast("string")), F.lit(""))
            else:
                number = plain_number(v)
                x = F.when(~F.isnan(number), number)
            asked.append((kind, x))
            return Value(F.col(f"_held{len(asked) - 1}"), BOOL)

        return run

    scope.calls = {**scope.calls, "isMax": call("max"), "isMin": call("min"), "isMode": call("mode")}
    v = scope.column(where)
    if v.kind != BOOL:
        raise ExpressionError(f"expected true or false: {where!r}")
    columns = df.columns
    df = df.withColumns({f"_x{i}": x for i, (_, x) in enumerate(asked)}) if asked else df
    ends = {f"_end{i}": (F.max if kind == "max" else F.min)(f"_x{i}") for i, (kind, _) in enumerate(asked) if kind != "mode"}
    if ends:
        df = salted_join(df, df.groupBy(*by).agg(*[c.alias(n) for n, c in ends.items()]), by, row, "left")
    for i, (kind, _) in enumerate(asked):
        if kind != "mode":
            df = df.withColumn(f"_held{i}", F.coalesce(F.col(f"_x{i}") == F.col(f"_end{i}"), F.lit(False)))
            continue
        counts = df.groupBy(*by, f"_x{i}").agg(F.count(F.lit(1)).alias("_n"))
        top = counts.groupBy(*by).agg(F.max("_n").alias("_most"))
        modes = salted_join(counts, top, by, F.col(f"_x{i}"), "inner").where(F.col("_n") == F.col("_most")).select(*by, f"_x{i}", F.lit(True).alias(f"_held{i}"))
        df = salted_join(df, modes, [*by, f"_x{i}"], row, "left").withColumn(f"_held{i}", F.coalesce(f"_held{i}", F.lit(False)))
    return df.where(v.col).select(*[F.col(f"`{c}`") for c in columns])


def filtered(pairs: DataFrame, target: Layer, source: Layer, where: str, defs: dict) -> DataFrame:
    """Pairs for which ``where`` holds: source fields by name, target fields as ``target.x``."""
    t = target.df.select(F.col(FID).alias("_t"), *[F.col(f"`{f}`").alias(f"_t_{f}") for f in target.fields])
    s = source.df.withColumnRenamed(FID, "_s").drop(GEOM)
    scope = translator(source, defs)
    scope.others = {"target": {f: Value(F.col(f"`_t_{f}`"), v.kind, v.item) for f, v in translator(target).fields.items()}}
    return tested(pairs.select("_t", "_s").join(s, "_s").join(t, "_t"), ["_t"], scope, where, F.col("_s")).select("_t", "_s")


def _of_target(where: str) -> bool:
    """Whether a condition reads fields of the target."""
    return any(x == ("name", "target") for node in parse(where) for x in walk(node))


def copied_fields(target: Layer, source: Layer, options: JoinOptions, source_key: str | None) -> list[tuple[str, str]]:
    """(source field, new name) of the fields to copy."""
    if options.fields is None:
        names = [] if options.calc else [f for f in source.fields if f != source_key]
    elif "*" in options.fields:
        names = source.fields
    else:
        names = options.fields
        source.need(*names)
    names = [n for n in names if n not in options.sum_fields]
    pairs = [(n, options.prefix + n) for n in names]
    return [(n, new) for n, new in pairs if options.force or new not in target.fields]


def _first_and_sums(copy: list[tuple[str, str]], sum_fields: list[str], value: str, order: str) -> dict[str, Column]:
    """Aggregates over the matches of a row: the fields of the first one, and sums; ``value`` goes before field names."""
    aggs = {f"_v_{n}": F.min_by(F.struct(F.col(f"`{value}{n}`").alias("v")), F.col(order))["v"] for n, _ in copy}
    return aggs | {f"_sum_{n}": F.coalesce(F.sum(plain_number(Value(F.col(f"`{value}{n}`"), NUM))), F.lit(0.0)) for n in sum_fields}


def _placed(out: DataFrame, target: Layer, source: Layer, copy: list[tuple[str, str]], options: JoinOptions, hit: Column) -> DataFrame:
    """``out`` with the copied fields and sums under their names; what is there stays where there is no match."""
    for n, new in copy:
        value = F.col(f"`_v_{n}`")
        out = out.withColumn(new, F.when(hit, value).otherwise(F.col(f"`{new}`").cast(dict(source.df.dtypes)[n])) if new in target.fields else value)
    for n in options.sum_fields:
        new = options.prefix + n
        out = out.withColumn(new, F.coalesce(F.col(f"_sum_{n}"), F.col(f"`{new}`").cast("double") if new in target.fields else F.lit(None), F.lit(0.0)))
    return out.drop(*[f"_v_{n}" for n, _ in copy], *[f"_sum_{n}" for n in options.sum_fields])


def join(target: Layer, source: Layer, pairs: DataFrame, options: JoinOptions | None = None, source_key: str | None = None) -> Joined:
    """The target with fields of its matches.

    Unmatched rows get nulls, and 0 for ``sum_fields``; an existing field of the same name is only replaced with
    ``force`` (and keeps its value where there is no match). ``calc`` is also run for rows without a match. With
    ``duplication`` every further match adds a copy of the target row at the end of the table.
    """
    options = options or JoinOptions()
    if options.duplication and options.calc:
        raise LayerError("duplication can't be combined with calc")
    pairs = pairs.select("_t", "_s")
    if options.where:
        pairs = filtered(pairs, target, source, options.where, options.defs)
    copy = copied_fields(target, source, options, source_key)
    source.need(*options.sum_fields)
    wanted = list(dict.fromkeys([n for n, _ in copy] + options.sum_fields))
    src = source.df.select(F.col(FID).alias("_s"), *[F.col(f"`{n}`").alias(f"_v_{n}") for n in wanted])
    out = target.df
    if options.duplication:
        matched = pairs.join(src, "_s") if wanted else pairs
        first = F.row_number().over(Window.partitionBy("_t").orderBy("_s"))
        matched = matched.withColumn("_nth", first)
        out = out.join(matched, out[FID] == matched["_t"], "left")
    else:
        aggs = _first_and_sums(copy, options.sum_fields, "_v_", "_s")
        if aggs:
            best = (pairs.join(src, "_s") if wanted else pairs).groupBy("_t").agg(*[c.alias(n) for n, c in aggs.items()], F.lit(True).alias("_hit"))
            out = out.join(best, out[FID] == best["_t"], "left")
    if options.duplication:
        if options.sum_fields:
            raise LayerError("duplication can't be combined with sum-fields")
        out = _placed(out, target, source, copy, options, F.col("_nth").isNotNull())
        # copies are numbered after the last row, by target row and match
        late = F.col("_nth") > 1
        out = out.withColumn("_order", F.struct(F.coalesce(late, F.lit(False)).cast("int"), F.col(FID), F.coalesce("_nth", F.lit(1))))
        out = with_fid(out.orderBy("_order").drop(FID, "_order", "_t", "_s", "_nth"), shuffled=True)
    elif copy or options.sum_fields:
        out = _placed(out, target, source, copy, options, F.col("_hit")).drop("_t", "_hit")
    result = target.with_df(out)
    if options.calc:
        result = _calculated(result, source, pairs, options)
    used = pairs.select("_s").distinct()
    unjoined = source.df.join(used, source.df[FID] == used["_s"], "left_anti")
    unmatched = target.df.join(pairs.select("_t"), target.df[FID] == F.col("_t"), "left_anti")
    return Joined(result, unjoined, unmatched)


def _calculated(target: Layer, source: Layer, pairs: DataFrame, options: JoinOptions) -> Layer:
    """Aggregates over the matches of every target row, those without any included."""
    rows = pairs.join(source.df.withColumnRenamed(FID, "_s").drop(GEOM), "_s").withColumn(FID, F.col("_s"))
    plan, outputs = compiled(options.calc or "", translator(source, options.defs))
    values = grouped(rows, ["_t"], plan).select("_t", *[v.col.alias(f"_o_{n}") for n, v in outputs])
    out = target.df.join(values, target.df[FID] == values["_t"], "left")
    return target.with_df(_outputs(out, rows.drop("_t"), plan, outputs, F.col("_t").isNotNull()).drop("_t"))


def _outputs(out: DataFrame, rows: DataFrame, plan: Plan, outputs: list[tuple[str, Value]], hit: Column) -> DataFrame:
    """Calculated fields from their ``_o_`` columns; rows without a match get what the aggregates give of no rows."""
    none = grouped(rows.where(F.lit(False)), [], plan).select(*[v.col.alias(n) for n, v in outputs]).first()
    for n, _ in outputs:
        new = F.col(f"`_o_{n}`")
        out = out.withColumn(n, F.when(hit, new).otherwise(F.lit(none[n])) if none[n] is not None else new)
    return out.drop(*[f"_o_{n}" for n, _ in outputs])


def join_keys(target: Layer, source: Layer, keys: tuple[str, str], options: JoinOptions | None = None) -> Joined:
    """Equi-join: ``keys`` are the target's and the source's field; null keys match each other.

    The source is filtered and reduced to one row per key (a partial aggregation, so neither hot nor null keys gather
    anywhere), then meets the target, whose hot keys are salted. Only ``duplication``, and a ``where`` that reads
    fields of the target, go through pairs of rows.
    """
    options = options or JoinOptions()
    if options.duplication or (options.where and _of_target(options.where)):
        return join(target, source, key_matches(target, source, *keys), options, keys[1])
    t, s = checked_keys(target, source, *keys)
    if options.where:
        s = tested(s.drop(GEOM), KEY, translator(source, options.defs), options.where, F.col(FID))
    copy = copied_fields(target, source, options, keys[1])
    source.need(*options.sum_fields)
    plan, outputs = compiled(options.calc, translator(source, options.defs)) if options.calc else (Plan(), [])
    extra = _first_and_sums(copy, options.sum_fields, "", FID) | {"_hit": F.max(F.lit(True))}
    reduced = grouped(s, KEY, plan, extra).select(*KEY, "_hit", *[F.col(f"`{n}`") for n in extra if n != "_hit"], *[v.col.alias(f"_o_{n}") for n, v in outputs])
    out = salted_join(t, reduced, KEY, F.col(FID), "left").drop(*KEY)
    out = _placed(out, target, source, copy, options, F.col("_hit"))
    if options.calc:
        out = _outputs(out, s.drop(*KEY), plan, outputs, F.coalesce("_hit", F.lit(False)))
    used = salted_join(s.select(*KEY, F.col(FID).alias("_s")), t.select(*KEY).distinct(), KEY, F.col("_s"), "inner").select("_s")
    unjoined = source.df.join(used, source.df[FID] == used["_s"], "left_anti")
    unmatched = salted_join(t, reduced.select(*KEY), KEY, F.col(FID), "left_anti").drop(*KEY)
    return Joined(target.with_df(out.drop("_hit")), unjoined, unmatched)


def interpolated(target: Layer, source: Layer, fields: list[str]) -> Layer:
    """Fields of overlapping polygons, weighted by area: numbers add their share, texts come from the largest overlap."""
    from geolathe.operators.overlay import overlap_areas

    source.need(*fields)
    kinds = translator(source).fields
    pairs = overlap_areas(target, source)
    src = source.df.select(F.col(FID).alias("_s"), F.abs(G.area(F.col(GEOM))).alias("_own"), *[F.col(f"`{f}`") for f in fields])
    df = pairs.join(src, "_s")
    numbers = [f for f in fields if kinds[f].kind == NUM]
    texts = [f for f in fields if f not in numbers]
    out = target.df.drop(*fields)
    if numbers:
        sums = df.groupBy("_t").agg(*[F.sum(F.col("area") / F.col("_own") * F.col(f"`{f}`")).alias(f) for f in numbers])
        out = out.join(sums, out[FID] == sums["_t"], "left").drop("_t")
    for f in texts:
        by_value = df.groupBy("_t", f).agg(F.sum("area").alias("_a"), F.min("_s").alias("_i"))
        best = by_value.groupBy("_t").agg(F.min_by(F.struct(F.col(f"`{f}`").alias("v")), F.struct(-F.col("_a"), F.col("_i")))["v"].alias(f))
        out = out.join(best, out[FID] == best["_t"], "left").drop("_t")
    return target.with_df(out)


def fuzzy_join(polygons: Layer, points: Layer, name: str, no_dropouts: bool = False) -> Layer:
    """Gives each polygon the value that most of its points hold; ties go to the value whose points come first.

    With ``no_dropouts`` a value that no polygon got is given to the polygon holding most of its points.
    """
    points.need(name)
    m = point_in_polygon(points, polygons).join(points.df.select(F.col(FID).alias("id"), F.col(f"`{name}`").alias("_v")), "id").where(F.col("_v").isNotNull())
    counts = m.groupBy("region", "_v").agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("_i"))
    best = counts.groupBy("region").agg(F.min_by("_v", F.struct(-F.col("_n"), F.col("_i"))).alias("_v"))
    if no_dropouts:
        lost = counts.join(best.select("_v").distinct(), "_v", "left_anti")
        back = lost.groupBy("_v").agg(F.min_by("region", F.struct(-F.col("_n"), F.col("_i"))).alias("region"))
        back = back.groupBy("region").agg(F.min("_v").alias("_w"))
        best = best.join(back, "region", "left").select("region", F.coalesce("_w", "_v").alias("_v"))
    best = best.withColumnRenamed("region", "_region")
    out = polygons.df.drop(name).join(best, F.col(FID) == F.col("_region"), "left").withColumn(name, F.col("_v")).drop("_region", "_v")
    return polygons.with_df(out)
