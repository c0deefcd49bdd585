"""Commands on attribute tables: fields, filters, sorting, duplicates, aggregation, merging and splitting of layers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geolathe.functions import geometry as G
from geolathe.functions.aggregates import Plan, compiled, grouped, sources
from geolathe.functions.expressions import ARR, BOOL, NUM, STR, ExpressionError, Translator, Value, kind_of, number, parse, plain_number, text, truth
from geolathe.layer import FID, GEOM, Layer, LayerError, with_fid
from geolathe.session import cut, written


def translator(layer: Layer, defs: dict | None = None) -> Translator:
    """The expression scope of a layer's features: fields, definitions and the members of ``this``."""
    names = [c for c in layer.df.columns if c not in (FID, GEOM)]
    schema = T.StructType([f for f in layer.df.schema.fields if f.name in names])
    return Translator.of(schema, this=this_members(layer), defs=defs or {}, calls=bbox_calls(layer))


def this_members(layer: Layer) -> dict:
    num = lambda c: Value(c, NUM)
    out = {"id": lambda: num(F.col(FID).cast("double")), "layer_name": lambda: Value(F.lit(layer.name), STR)}
    g = F.col(GEOM)
    if not layer.geometry_type:
        return out
    point, sphere = layer.geometry_type == "point", layer.lat_long
    box = G.bounds(g, point)
    out |= {
        "isNull": lambda: Value(g.isNull() | (F.size(g) == 0), BOOL),
        "partCount": lambda: num(F.coalesce(F.size(g), F.lit(0)).cast("double")),
        "bbox": lambda: Value(F.array(box["xmin"], box["ymin"], box["xmax"], box["ymax"]), ARR, NUM),
        "bounds": lambda: Value(F.array(box["xmin"], box["ymin"], box["xmax"], box["ymax"]), ARR, NUM),
        "width": lambda: num(box["xmax"] - box["xmin"]),
        "height": lambda: num(box["ymax"] - box["ymin"]),
        "coordinates": lambda: Value(g, ARR, ARR),
    }
    if point:
        return out | {"x": lambda: num(F.get(g, F.lit(0))[0]), "y": lambda: num(F.get(g, F.lit(0))[1])}
    out |= {"length": lambda: num(G.length(g, sphere)), "perimeter": lambda: num(G.length(g, sphere))}
    if layer.geometry_type == "polygon":
        out |= {
            "area": lambda: num(G.area(g, sphere)),
            "planarArea": lambda: num(G.area(g)),
            "originalArea": lambda: num(G.area(g, sphere)),
            "compactness": lambda: num(G.compactness(g, sphere)),
            "centroidX": lambda: num(G.centroid(g)[0]),
            "centroidY": lambda: num(G.centroid(g)[1]),
        }
    return out


def bbox_calls(layer: Layer) -> dict:
    if not layer.geometry_type:
        return {}
    box = G.bounds(F.col(GEOM), layer.geometry_type == "point")

    def make(test):  # noqa: ANN001, ANN202
        return lambda args, t: Value(test(*[number(t.value(a)) for a in (args if len(args) > 1 else args[0][1])]), BOOL)

    return {
        "bboxContainsPoint": make(lambda x, y: (box["xmin"] <= x) & (box["xmax"] >= x) & (box["ymin"] <= y) & (box["ymax"] >= y)),
        "bboxIntersectsRectangle": make(lambda a, b, c, d: (box["xmin"] <= c) & (box["xmax"] >= a) & (box["ymin"] <= d) & (box["ymax"] >= b)),
        "bboxContainsRectangle": make(lambda a, b, c, d: (box["xmin"] <= a) & (box["xmax"] >= c) & (box["ymin"] <= b) & (box["ymax"] >= d)),
        "bboxContainedByRectangle": make(lambda a, b, c, d: (box["xmin"] >= a) & (box["xmax"] <= c) & (box["ymin"] >= b) & (box["ymax"] <= d)),
    }


# --- running totals -----------------------------------------------------------------------------------------------


def _step(node: tuple, name: str) -> tuple | None:
    """What ``global.name = (global.name || 0) + x`` adds (x), with or without the default; None for anything else."""
    held = ("member", ("name", "global"), name)
    if node[0] == "binary" and node[1] == "+" and node[2] in (held, ("binary", "||", held, ("num", 0.0))):
        return node[3]
    return None


def split_globals(expression: str) -> list[tuple[str, object]]:
    """Statements of an expression, ``run`` ones (name, what is added) apart from the others (``each``, node)."""
    out: list[tuple[str, object]] = []
    for node in parse(expression):
        field_name = None
        if node[0] == "assign" and node[2][0] == "assign":  # f = global.n = ...
            field_name, node = node[1], node[2]
        target = node[1] if node[0] == "assign" else ("", "")
        if target[0] == "member" and target[1] == ("name", "global"):
            added = _step(node[2], target[2])
            if added is None:
                raise ExpressionError(f"global.{target[2]} can only be a running total: global.{target[2]} = (global.{target[2]} || 0) + x")
            out.append(("run", (target[2], added)))
            if field_name is not None:
                out.append(("each", ("assign", field_name, target)))
        else:
            out.append(("each", node))
    return out


def running_totals(layer: Layer, added: list[Column], names: list[str]) -> DataFrame:
    """``layer.df`` with the sums of some columns over the rows up to each, in row order.

    Rows are sorted into ranges; each range is summed by itself, and what the ranges before add up to (a number per
    range and column, through the driver) is put on top.
    """
    df = layer.df.withColumns({f"_add{i}": F.coalesce(c.cast("double"), F.lit(0.0)) for i, c in enumerate(added)})
    df = cut(df.orderBy(FID)).withColumn("_range", F.spark_partition_id())
    sums = {r["_range"]: r for r in df.groupBy("_range").agg(*[F.sum(f"_add{i}").alias(f"_add{i}") for i in range(len(added))]).collect()}
    before = [[0.0] * len(added)]
    for p in range(max(sums, default=-1)):
        before.append([b + (sums[p][f"_add{i}"] if p in sums else 0.0) for i, b in enumerate(before[-1])])
    offsets = df.sparkSession.createDataFrame([(p, b) for p, b in enumerate(before)], "_range int, _before array<double>")  # a row per range
    window = Window.partitionBy("_range").orderBy(FID).rowsBetween(Window.unboundedPreceding, 0)
    df = df.join(F.broadcast(offsets), "_range")
    df = df.withColumns({n: F.sum(f"_add{i}").over(window) + F.col("_before")[i] for i, n in enumerate(names)})
    return df.drop("_range", "_before", *[f"_add{i}" for i in range(len(added))])


# --- fields --------------------------------------------------------------------------------------------------------


def each(layer: Layer, expression: str, where: str | None = None, ids: list[int] | None = None, defs: dict | None = None) -> Layer:
    """Assigns fields, one statement after the other; rows not selected by ``where`` and ``ids`` keep their values.

    New fields are null where nothing is assigned. ``global.n = (global.n || 0) + x`` is a running total in row order
    over the selected rows, which later statements read as ``global.n``. Assigning to this.x or this.y moves points. ``delete f`` and
    ``delete this.properties.f`` drop a field; ``this.properties = {..}`` replaces all fields by those of the object. An
    empty table gets the new fields.
    """
    df = layer.df
    chosen: Column | None = strict(layer, where, defs) if where else None
    if ids is not None:
        chosen = F.col(FID).isin(ids) if chosen is None else chosen & F.col(FID).isin(ids)
    if chosen is not None:
        df = df.withColumn("_chosen", chosen)
    totals: dict[str, Value] = {}
    for kind, node in split_globals(expression):
        current = layer.with_df(df)
        if kind == "run":
            name, added = node  # type: ignore[misc]
            t = translator(current, defs)
            t.others = {"global": totals}
            more = plain_number(t.value(added))
            df = running_totals(current, [F.when(F.col("_chosen"), more) if chosen is not None else more], [f"_global_{name}"])
            totals[name] = Value(F.col(f"_global_{name}"), NUM)
            continue
        if node[0] == "delete":
            target = node[1]
            df = df.drop(target[1] if target[0] == "name" else target[2])
            continue
        if node[0] != "assign":
            continue
        target = node[1]
        t = translator(current, defs)
        t.others = {"global": totals} if totals else t.others
        t.fields.pop("_chosen", None)
        if target == ("member", ("name", "this"), "properties"):
            if chosen is not None or node[2][0] != "object":
                raise ExpressionError("a record can only be replaced by an object, in all rows")
            made = [(k, t.value(v)) for k, v in node[2][1]]
            kept = [*layer.system, *[f"_global_{n}" for n in totals]]
            df = df.select(*kept, *[(v.col.cast("string") if v.kind == "null" else v.col).alias(k) for k, v in made])
            continue
        value = t.value(node[2])
        if target[0] == "member" and target[1] == ("name", "this") and target[2] in ("x", "y") and layer.geometry_type == "point":
            old = F.col(GEOM)[0]
            moved = F.array(F.array(number(value), old[1]) if target[2] == "x" else F.array(old[0], number(value)))
            df = df.withColumn(GEOM, F.when(F.col("_chosen"), moved).otherwise(F.col(GEOM)) if chosen is not None else moved)
            continue
        name = target[1] if target[0] == "name" else target[2] if target[0] == "member" else target[2][1]
        new = value.col.cast("string") if value.kind == "null" and name not in df.columns else value.col
        if chosen is not None:
            old = F.col(f"`{name}`") if name in df.columns else F.lit(None)
            if name in df.columns and t.fields.get(name) is not None and t.fields[name].kind == NUM and value.kind == NUM:
                old = old.cast("double")
            new = F.when(F.col("_chosen"), new).otherwise(old)
        df = df.withColumn(name, new)
    return layer.with_df(df.drop("_chosen", *[f"_global_{n}" for n in totals]))


def filter_fields(layer: Layer, names: list[str], invert: bool = False) -> Layer:
    """Keeps the listed fields, in that order; ``new=old`` renames. No names: no fields."""
    pairs = [(n.split("=", 1) + [n])[:2] if "=" in n else [n, n] for n in names]
    layer.need(*[old for _, old in pairs])
    if invert:
        gone = {old for _, old in pairs}
        pairs = [[f, f] for f in layer.fields if f not in gone]
    return layer.with_df(layer.df.select(*layer.system, *[F.col(f"`{old}`").alias(new) for new, old in pairs]))


def rename_fields(layer: Layer, names: list[str]) -> Layer:
    """``new=old``; the other fields and the order stay. A source that isn't there is an error."""
    pairs = dict(reversed(n.split("=", 1)) for n in names)  # type: ignore[arg-type]
    layer.need(*pairs)
    return layer.with_df(layer.df.withColumnsRenamed(pairs))


def drop(layer: Layer, fields: list[str] | None = None, geometry: bool = False, holes: bool = False) -> Layer:
    """Drops fields (``*``: all), the geometry, or the holes of polygons. Unknown fields are passed over."""
    df = layer.df
    if fields:
        df = df.drop(*(layer.fields if "*" in fields else fields))
    if holes:
        layer.need_geometry("polygon")
        df = df.withColumn(GEOM, F.filter(GEOM, lambda ring: G.ring_area(ring) > 0))
    if geometry:
        return layer.with_df(df.drop(GEOM), geometry_type=None)
    return layer.with_df(df)


# --- rows ----------------------------------------------------------------------------------------------------------


def strict(layer: Layer, expression: str, defs: dict | None = None) -> Column:
    """The expression as a condition; it must be boolean, and a null result is an error."""
    v = translator(layer, defs).column(expression)
    if v.kind != BOOL:
        raise ExpressionError(f"expected true or false: {expression!r}")
    return F.coalesce(v.col, F.raise_error(F.lit(f"expected true or false, got null: {expression}")).cast("boolean")) if _nullable(expression) else v.col


def _nullable(expression: str) -> bool:
    """Only a bare field or member can be null; comparisons and logic never are."""
    return parse(expression)[0][0] in ("name", "member", "index", "if", "call")


def filter_rows(layer: Layer, expression: str | None = None, invert: bool = False, ids: list[int] | None = None, bbox: list[float] | None = None, remove_empty: bool = False, defs: dict | None = None) -> Layer:
    """Keeps the rows for which all the given tests hold; ``invert`` turns the outcome around."""
    tests: list[Column] = []
    if expression:
        tests.append(strict(layer, expression, defs))
    if ids is not None:
        tests.append(F.col(FID).isin(ids) if ids else F.lit(False))
    if bbox is not None:
        tests.append(F.coalesce(meets_bbox(layer, bbox), F.lit(False)))
    if remove_empty:
        tests.append(not_empty(layer))
    keep = F.lit(True)
    for t in tests:
        keep = keep & t
    return layer.with_df(layer.df.where(~keep if invert else keep))


def not_empty(layer: Layer) -> Column:
    g = F.col(GEOM)
    if not layer.geometry_type:
        return F.lit(True)
    some = g.isNotNull() & (F.size(g) > 0)
    return some & (G.area(g) > 0) if layer.geometry_type == "polygon" else some


def meets_bbox(layer: Layer, bbox: list[float]) -> Column:
    """Whether a feature meets the box: a point in it, a segment crossing it, or a polygon around it."""
    x0, y0, x1, y1 = [F.lit(float(v)) for v in bbox]
    g = F.col(GEOM)
    inside = lambda p: (p[0] >= x0) & (p[0] <= x1) & (p[1] >= y0) & (p[1] <= y1)
    if layer.geometry_type == "point":
        return F.exists(g, inside)

    def crosses(a: Column, b: Column) -> Column:
        apart = (F.greatest(a[0], b[0]) < x0) | (F.least(a[0], b[0]) > x1) | (F.greatest(a[1], b[1]) < y0) | (F.least(a[1], b[1]) > y1)
        side = lambda x, y: F.signum((b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]))
        corners = [side(x, y) for x in (x0, x1) for y in (y0, y1)]
        return ~apart & ~((F.least(*corners) > 0) | (F.greatest(*corners) < 0))

    meets = F.exists(g, lambda part: F.exists(G.segments(part, lambda a, b: F.when(crosses(a, b), 1.0).otherwise(0.0)), lambda v: v > 0))
    if layer.geometry_type == "polygon":  # or the box lies within: odd crossings to the left of a corner
        ray = lambda a, b: F.when(((a[1] > y0) != (b[1] > y0)) & (x0 > a[0] + (y0 - a[1]) * (b[0] - a[0]) / F.when(b[1] != a[1], b[1] - a[1])), 1.0).otherwise(0.0)
        meets = meets | (G.over_parts(g, lambda part: G.total(G.segments(part, ray))) % 2 == 1)
    return meets


def filter_geom(layer: Layer, bbox: list[float]) -> Layer:
    """Drops the parts whose bounds are outside of the box, then the features left without parts."""
    x0, y0, x1, y1 = bbox
    if layer.geometry_type == "point":
        kept = F.filter(GEOM, lambda p: p[0].between(x0, x1) & p[1].between(y0, y1))
    else:
        xs, ys = (lambda r: F.transform(r, lambda p: p[0])), (lambda r: F.transform(r, lambda p: p[1]))
        kept = F.filter(GEOM, lambda r: (F.array_max(xs(r)) >= x0) & (F.array_min(xs(r)) <= x1) & (F.array_max(ys(r)) >= y0) & (F.array_min(ys(r)) <= y1))
    return layer.with_df(layer.df.withColumn(GEOM, kept).where(F.size(GEOM) > 0))


def sort(layer: Layer, expression: str, descending: bool = False, defs: dict | None = None) -> Layer:
    """Stable sort; null and NaN come last either way. Row ids are given anew.

    New ids are ranks: a range-partitioned sort, the rows before each partition added to the place in it.
    """
    v = translator(layer, defs).column(expression)
    key = F.when(~F.isnan(v.col), v.col) if v.kind == NUM and dict(layer.df.dtypes).get(expression, "double") in ("double", "float") else v.col
    ranked = layer.df.withColumn("_key", key).orderBy(F.col("_key").desc_nulls_last() if descending else F.col("_key").asc_nulls_last(), FID)
    return layer.with_df(with_fid(ranked.drop("_key", FID), shuffled=True))


def uniq(layer: Layer, expression: str, max_count: int = 1, index: bool = False, invert: bool = False, defs: dict | None = None) -> Layer:
    """Keeps the first ``max_count`` rows of each value in row order; ``invert`` the later ones; ``index`` numbers all.

    For one row per value a partial aggregation finds it before any shuffle of whole rows; otherwise rows are numbered
    within their value.
    """
    v = translator(layer, defs).column(expression)
    df = layer.df.withColumn("_key", v.col.cast("string"))
    if max_count == 1 and not index:
        first = df.groupBy("_key").agg(F.min(FID).alias(FID))
        return layer.with_df(df.drop("_key").join(first.select(FID), FID, "left_anti" if invert else "left_semi"))
    number_ = F.row_number().over(Window.partitionBy("_key").orderBy(FID))
    if index:
        return layer.with_df(df.withColumn("index", number_.cast("long")).drop("_key"))
    df = df.withColumn("_n", number_)
    return layer.with_df(df.where(F.col("_n") > max_count if invert else F.col("_n") <= max_count).drop("_n", "_key"))


# --- aggregation ---------------------------------------------------------------------------------------------------


def calc(layer: Layer, expression: str, where: str | None = None, defs: dict | None = None) -> dict[str, object]:
    """Values of aggregates over the layer, by name: one pass."""
    df = layer.df.where(strict(layer, where, defs)) if where else layer.df
    plan, outputs = compiled(expression, translator(layer, defs), point=None if not layer.geometry_type else layer.geometry_type == "point")
    return grouped(df, [], plan).select(*[v.col.alias(n) for n, v in outputs]).first().asDict()


def calc_table(layer: Layer, expression: str, where: str | None = None, defs: dict | None = None) -> DataFrame:
    """``calc`` as a table of expression, value (as text), where and layer_name."""
    df = layer.df.where(strict(layer, where, defs)) if where else layer.df
    plan, outputs = compiled(expression, translator(layer, defs), point=None if not layer.geometry_type else layer.geometry_type == "point")
    one = grouped(df, [], plan)
    rows = [F.struct(F.lit(s).alias("expression"), F.when(v.col.isNotNull(), text(v)).alias("value"), *([F.lit(where).alias("where")] if where else []), F.lit(layer.name).alias("layer_name")) for s, (_, v) in zip(sources(expression), outputs)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def dissolve(layer: Layer, fields: list[str] | None = None, calc: str | None = None, sum_fields: list[str] | None = None, copy_fields: list[str] | None = None, where: str | None = None, defs: dict | None = None) -> Layer:
    """Groups rows by fields (all in one group without any): keys, copied fields of the first row, sums and aggregates.

    Groups keep the order of their first rows. With ``where`` the other rows come first, untouched, followed by the
    groups of the selected ones; fields of one kind of row are null in the other.
    """
    keys = fields or []
    layer.need(*keys, *(sum_fields or []), *(copy_fields or []))
    df = layer.df
    rest = None
    if where:
        test = strict(layer, where, defs)
        df, rest = layer.df.where(test), layer.df.where(~test)
    plan, outputs = compiled(calc, translator(layer, defs), point=None if not layer.geometry_type else layer.geometry_type == "point") if calc else (Plan(), [])
    extra = {FID: F.min(FID)}
    extra |= {f"_c_{f}": F.min_by(F.struct(F.col(f"`{f}`").alias("v")), F.col(FID))["v"] for f in copy_fields or []}
    extra |= {f"_t_{f}": F.coalesce(F.sum(plain_number(Value(F.col(f"`{f}`"), NUM))), F.lit(0.0)) for f in sum_fields or []}
    out = grouped(df, keys, plan, extra)
    if not keys:
        out = out.where(F.col(FID).isNotNull())
    cols = [F.col(FID), *[F.col(f"`{k}`") for k in keys], *[F.col(f"`_c_{f}`").alias(f) for f in copy_fields or [] if f not in keys], *[F.col(f"`_t_{f}`").alias(f) for f in sum_fields or [] if f not in keys], *[v.col.alias(n) for n, v in outputs]]
    out = out.select(*cols)
    if rest is not None:
        rest = rest.drop(GEOM)
        out = rest.withColumn("_late", F.lit(0)).unionByName(out.withColumn("_late", F.lit(1)), allowMissingColumns=True)
        most = layer.df.agg(F.max(FID)).first()[0] or 0
        out = out.withColumn(FID, F.col(FID) + F.col("_late") * F.lit(int(most) + 1)).drop("_late")
    return layer.with_df(out, geometry_type=None)


# --- layers --------------------------------------------------------------------------------------------------------


def _coarse(t: T.DataType) -> str:
    return kind_of(t)[0]


def merge_layers(layers: list[Layer], force: bool = False, name: str = "") -> Layer:
    """All rows of the layers, one after the other, by field names.

    Layers without rows are left out. Fields that some layers lack are an error, or null with ``force``; fields of
    different types and geometries of different types always are errors.
    """
    layers = [x for x in layers if not x.df.isEmpty()] or layers[:1]
    if not layers:
        raise LayerError("nothing to merge")
    types = {x.geometry_type for x in layers if x.geometry_type}
    if len(types) > 1:
        raise LayerError(f"can't merge geometries of several types: {', '.join(sorted(types))}")
    seen: dict[str, str] = {}
    for x in layers:
        for f in x.df.schema.fields:
            kind = _coarse(f.dataType)
            if f.name not in (FID, GEOM) and seen.setdefault(f.name, kind) != kind and "null" not in (kind, seen[f.name]):
                raise LayerError(f"field {f.name} has several types: {seen[f.name]}, {kind}")
    missing = sorted({f for x in layers for f in seen if f not in x.fields})
    if missing and not force:
        raise LayerError(f"some layers lack the fields {', '.join(missing)}")
    out, offset = None, 0
    for x in layers:
        top = x.df.agg(F.max(FID)).first()[0] or 0
        part = x.df.withColumn(FID, F.col(FID) + offset)
        for f in x.df.schema.fields:  # numbers of several widths meet as doubles
            if f.name not in (FID, GEOM) and isinstance(f.dataType, T.NumericType) and any(dict(y.df.dtypes).get(f.name, dict(x.df.dtypes)[f.name]) != dict(x.df.dtypes)[f.name] for y in layers):
                part = part.withColumn(f.name, F.col(f"`{f.name}`").cast("double"))
        offset += int(top) + 1
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return Layer(out, name or layers[0].name, next(iter(types), None), layers[0].crs)


def split_names(layer: Layer, expression: str | None = None, defs: dict | None = None) -> DataFrame:
    """``layer.df`` with ``layer_name``: the layer each row goes to."""
    if expression is None:
        prefix = layer.name or "layer"
        return layer.df.withColumn("layer_name", F.concat(F.lit(prefix + "-"), (F.col(FID) + 1).cast("string")))
    return layer.df.withColumn("layer_name", text(translator(layer, defs).column(expression)))


def split(layer: Layer, expression: str | None = None, ids: list[int] | None = None, defs: dict | None = None) -> dict[str, Layer]:
    """Layers by value, in the order of first appearance; ``ids`` gives two: those rows, and the others.

    Only the distinct names pass through the driver. The rows are written once, a folder for each name, so a layer
    reads its own rows only, however many there are.
    """
    if ids is not None:
        yes = F.col(FID).isin(ids)
        return {f"{layer.name or 'layer'}-1": layer.with_df(layer.df.where(yes)), f"{layer.name or 'layer'}-2": layer.with_df(layer.df.where(~yes))}
    named = written(split_names(layer, expression, defs), "split", by="layer_name")
    order = named.groupBy("layer_name").agg(F.min(FID).alias("_first")).orderBy("_first").collect()
    return {r["layer_name"]: layer.with_df(named.where(F.col("layer_name") == r["layer_name"]).drop("layer_name"), name=r["layer_name"]) for r in order}


def layer_bounds(layer: Layer) -> list[float] | None:
    """xmin, ymin, xmax, ymax of all features; None for an empty layer."""
    if not layer.geometry_type:
        return None
    box = G.bounds(F.col(GEOM), layer.geometry_type == "point")
    r = layer.df.agg(F.min(box["xmin"]), F.min(box["ymin"]), F.max(box["xmax"]), F.max(box["ymax"])).first()
    return None if r[0] is None else [float(v) for v in r]


def split_on_grid(layer: Layer, cols: int, rows: int, bbox: list[float] | None = None) -> DataFrame:
    """``layer.df`` with ``cell`` (r1c1 and so on): the grid cell of the centre of each feature's bounds."""
    b = bbox or layer_bounds(layer)
    if b is None:
        return layer.df.withColumn("cell", F.lit(None).cast("string"))
    box = G.bounds(F.col(GEOM), layer.geometry_type == "point")
    cx, cy = (box["xmin"] + box["xmax"]) / 2, (box["ymin"] + box["ymax"]) / 2
    place = lambda c, low, high, n: F.least(F.lit(n), F.greatest(F.lit(1), F.floor((c - low) / ((high - low) or 1.0) * n) + 1)).cast("int")
    return layer.df.withColumn("cell", F.concat(F.lit("r"), place(cy, b[1], b[3], rows).cast("string"), F.lit("c"), place(cx, b[0], b[2], cols).cast("string")))


def subdivide(layer: Layer, expression: str, defs: dict | None = None) -> DataFrame:
    """``layer.df`` with ``cell``: halved along the longer side of its bounds until the calc expression isn't true.

    A round handles all cells that still split at once: one aggregation and one numbering within cells. Cells of one
    row aren't split, so rounds end with the logarithm of the rows.
    """
    point = layer.geometry_type == "point"
    box = G.bounds(F.col(GEOM), point)
    df = layer.df.withColumn("_cx", (box["xmin"] + box["xmax"]) / 2).withColumn("_cy", (box["ymin"] + box["ymax"]) / 2).withColumn("cell", F.lit(""))
    while True:
        current = layer.with_df(df)
        plan, outputs = compiled(expression, translator(current, defs), point=point)
        stats = grouped(df, ["cell"], plan, {"_w": F.max("_cx") - F.min("_cx"), "_h": F.max("_cy") - F.min("_cy"), "_rows": F.count(F.lit(1))})
        todo = stats.where(truth(outputs[-1][1]) & (F.col("_rows") > 1)).select("cell", (F.col("_w") >= F.col("_h")).alias("_wide"), "_rows")
        if todo.isEmpty():
            return df.drop("_cx", "_cy")
        joined = df.join(todo, "cell", "left")
        order = Window.partitionBy("cell").orderBy(F.when(F.col("_wide"), F.col("_cx")).otherwise(F.col("_cy")), FID)
        half = F.row_number().over(order) <= F.ceil(F.col("_rows") / 2)
        df = joined.withColumn("cell", F.when(F.col("_rows").isNull(), F.col("cell")).otherwise(F.concat("cell", F.when(half, "a").otherwise("b")))).drop("_wide", "_rows")
        df = written(df, "subdivide")


# --- information ---------------------------------------------------------------------------------------------------


def info(layer: Layer) -> dict[str, object]:
    """Name, type, record count, null shapes, bounds and fields with the type and first value of each: one pass."""
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.min_by(F.col(f"`{f}`").cast("string"), F.when(F.col(f"`{f}`").isNotNull(), F.col(FID))).alias(f"v{i}") for i, f in enumerate(layer.fields)]
    if layer.geometry_type:
        aggs.append(F.sum((F.col(GEOM).isNull() | (F.size(GEOM) == 0)).cast("long")).alias("nulls"))
    r = layer.df.agg(*aggs).first()
    out: dict[str, object] = {"layer_name": layer.name, "geometry_type": layer.geometry_type, "feature_count": r["n"]}
    if layer.geometry_type:
        out |= {"null_shape_count": r["nulls"] or 0, "bbox": layer_bounds(layer), "proj4": layer.crs}
    kinds = {f.name: _coarse(f.dataType) for f in layer.df.schema.fields}
    return out | {"attribute_data": [{"field": f, "type": kinds[f], "first_value": r[f"v{i}"]} for i, f in enumerate(layer.fields)]}


def inspect(layer: Layer, expression: str, defs: dict | None = None) -> dict | None:
    """The one row that matches, or None if there is none or more than one."""
    rows = layer.df.where(strict(layer, expression, defs)).limit(2).collect()
    return rows[0].asDict(recursive=True) if len(rows) == 1 else None


def field_list(names: str) -> list[str]:
    """Names of a comma-separated option, quotes taken off."""
    return [re.sub(r"^(['\"])(.*)\1$", r"\2", x.strip()) for x in re.findall(r"(?:'[^']*'|\"[^\"]*\"|[^,])+", names) if x.strip()]
