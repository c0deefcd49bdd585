"""Point layers and grids: points from fields, centroids, grids of points and cells, points counted into cells."""

from __future__ import annotations

import math
import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from geolathe.functions import geometry as G
from geolathe.functions.aggregates import Plan, compiled, grouped
from geolathe.functions.expressions import STR, parse_dms
from geolathe.layer import FID, GEOM, Layer, LayerError, points_of
from geolathe.operators.table import layer_bounds, strict, translator

# Names of coordinate fields.
X_NAMES, Y_NAMES = r"^(lng|long?|longitude|x)$", r"^(lat|latitude|y)$"


def points_from_fields(layer: Layer, x: str | None = None, y: str | None = None) -> Layer:
    """Points from two fields holding numbers, numeric text or degrees, minutes and seconds; null where unreadable.

    Without names the fields are found by their usual names.
    """
    x = x or next((f for f in layer.fields if re.match(X_NAMES, f, re.I)), None)
    y = y or next((f for f in layer.fields if re.match(Y_NAMES, f, re.I)), None)
    if not x or not y:
        raise LayerError("no coordinate fields")
    layer.need(x, y)
    kinds = translator(layer).fields
    df = layer.df
    for new, name in (("_px", x), ("_py", y)):
        c = F.col(f"`{name}`")
        if kinds[name].kind == STR:
            t = F.trim(c)
            c = F.when(t != "", F.coalesce(t.try_cast("double"), parse_dms(t)))
        df = df.withColumn(new, c.cast("double"))
    made = points_of(layer.with_df(df), "_px", "_py")
    return made.with_df(made.df.drop("_px", "_py"))


def centroids(layer: Layer) -> Layer:
    """The area centroid of each polygon's largest ring."""
    layer.need_geometry("polygon")
    cx, cy = G.centroid(F.col(GEOM))
    return layer.with_df(layer.df.withColumn(GEOM, F.when(cx.isNotNull(), F.array(F.array(cx, cy)))), geometry_type="point")


def vertices(layer: Layer, repeated: bool = False) -> Layer:
    """All vertices of each path as points: each once, or as often as they occur (``repeated``)."""
    layer.need_geometry("polyline", "polygon")
    flat = F.flatten(F.col(GEOM))
    return layer.with_df(layer.df.withColumn(GEOM, flat if repeated else F.array_distinct(flat)), geometry_type="point")


def endpoints(layer: Layer) -> Layer:
    """First and last points of the parts, each once."""
    layer.need_geometry("polyline", "polygon")
    ends = F.flatten(F.transform(GEOM, lambda part: F.array(F.get(part, F.lit(0)), F.element_at(part, -1))))
    return layer.with_df(layer.df.withColumn(GEOM, F.array_distinct(ends)), geometry_type="point")


def point_grid(spark: SparkSession, bbox: list[float] | None = None, cols: int | None = None, rows: int | None = None, interval: float | None = None) -> Layer:
    """A grid of points: in the middle of cols x rows cells of the box, or every ``interval``, centred in the box."""
    x0, y0, x1, y1 = bbox or [-180.0, -90.0, 180.0, 90.0]
    if interval:
        cols, rows = int((x1 - x0) / interval) + 1, int((y1 - y0) / interval) + 1
        dx = dy = float(interval)
        sx, sy = x0 + ((x1 - x0) - (cols - 1) * dx) / 2, y0 + ((y1 - y0) - (rows - 1) * dy) / 2
    elif cols and rows:
        dx, dy = (x1 - x0) / cols, (y1 - y0) / rows
        sx, sy = x0 + dx / 2, y0 + dy / 2
    else:
        raise LayerError("a grid needs an interval, or columns and rows")
    i = F.col("id")
    df = spark.range(cols * rows).select(i.alias(FID), F.array(F.array(F.lit(sx) + (i % cols) * dx, F.lit(sy) + F.floor(i / cols) * dy)).alias(GEOM))
    return Layer(df, "grid", "point")


#: Area of a cell with sides of 1.
CELL_AREA = {"square": 1.0, "square2": 1.0, "hex": 3 * math.sqrt(3) / 2, "hex2": 3 * math.sqrt(3) / 2, "rhombus": math.sqrt(3) / 2, "rhombus2": math.sqrt(3) / 2, "triangle": math.sqrt(3) / 4, "triangle2": math.sqrt(3) / 4}


def cell_side(kind: str, bbox: list[float], interval: float | None = None, cols: int | None = None, rows: int | None = None, cells: int | None = None) -> float:
    """The side of a cell; of several wishes, the one with the smallest cells counts."""
    if interval:
        return float(interval)
    w, h = bbox[2] - bbox[0], bbox[3] - bbox[1]
    sides = [w / cols] if cols else []
    sides += [h / rows] if rows else []
    sides += [math.sqrt(w * h / cells / CELL_AREA[kind])] if cells else []
    if not sides:
        raise LayerError("a grid needs an interval, columns, rows or cells")
    return min(sides)


def polygon_grid(spark: SparkSession, bbox: list[float], kind: str = "hex", **size: float) -> Layer:
    """Cells of a shape that cover the box, each with its id, column and row; cells outside of the box are left out.

    ``2`` variants are turned by a quarter. All from one range of numbers and arithmetic.
    """
    base, turned = kind.rstrip("2"), kind.endswith("2")
    side = cell_side(kind, bbox, **size)  # type: ignore[arg-type]
    x0, y0, x1, y1 = bbox
    if turned:
        x0, y0, x1, y1 = y0, x0, y1, x1
    root = math.sqrt(3)
    dx, dy = {"square": (side, side), "hex": (1.5 * side, root * side), "rhombus": (side, root / 2 * side), "triangle": (side / 2, root / 2 * side)}[base]
    slant = base == "rhombus"
    nx, ny = math.ceil((x1 - x0) / dx) + 2 + (math.ceil((y1 - y0) / dy / 2) if slant else 0), math.ceil((y1 - y0) / dy) + 2
    i = F.col("id")
    col, row = (i % nx).cast("int") - 1 - (math.ceil((y1 - y0) / dy / 2) if slant else 0), F.floor(i / nx).cast("int") - 1
    odd = F.pmod(col, F.lit(2)) == 1
    px, py = F.lit(x0) + col * dx, F.lit(y0) + row * dy
    if base == "square":
        offsets = [(0, 0), (0, side), (side, side), (side, 0)]
        ring = [(px + a, py + b) for a, b in offsets]
    elif base == "hex":
        cy = py + F.when(odd, F.lit(dy / 2)).otherwise(F.lit(0.0))
        ring = [(px + side * math.cos(math.radians(a)), cy + side * math.sin(math.radians(a))) for a in (180, 120, 60, 0, -60, -120)]
    elif base == "rhombus":
        sx = px + row * (side / 2)
        ring = [(sx, py), (sx + side / 2, py + dy), (sx + 1.5 * side, py + dy), (sx + side, py)]
    else:
        up = F.pmod(col + row, F.lit(2)) == 0
        low, high = F.when(up, py).otherwise(py + dy), F.when(up, py + dy).otherwise(py)
        a, b, c = (px - side / 2, low), (px, high), (px + side / 2, low)
        ring = [(a[0], a[1]), (F.when(up, b[0]).otherwise(c[0]), F.when(up, b[1]).otherwise(c[1])), (F.when(up, c[0]).otherwise(b[0]), F.when(up, c[1]).otherwise(b[1]))]
    points = [(y, x) if turned else (x, y) for x, y in ring]
    points = points[:1] + points[:0:-1] if turned else points
    closed = [*points, points[0]]
    shape = F.array(*[F.array(*[v.cast("double") for v in p]) for p in closed])
    df = spark.range(nx * ny).select(i.alias("_i"), col.alias("col"), row.alias("row"), F.array(shape).alias(GEOM))
    box = G.bounds(F.col(GEOM), False)
    b0, b1, b2, b3 = bbox
    inside = (box["xmax"] > b0) & (box["xmin"] < b2) & (box["ymax"] > b1) & (box["ymin"] < b3)
    return Layer(df.where(inside).select(F.col("_i").alias(FID), F.col("_i").alias("id"), "col", "row", GEOM), "grid", "polygon")


def circle_overlap(distance: F.Column, r1: float, r2: float) -> F.Column:
    """Area shared by two circles."""
    d = F.greatest(distance, F.lit(1e-300))
    small = math.pi * min(r1, r2) ** 2
    cos1 = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), (d * d + r1 * r1 - r2 * r2) / (d * (2 * r1))))
    cos2 = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), (d * d + r2 * r2 - r1 * r1) / (d * (2 * r2))))
    under = F.greatest(F.lit(0.0), (-d + r1 + r2) * (d + r1 - r2) * (d - r1 + r2) * (d + r1 + r2))
    lens = F.acos(cos1) * (r1 * r1) + F.acos(cos2) * (r2 * r2) - F.sqrt(under) / 2
    return F.when(distance >= r1 + r2, 0.0).when(distance <= abs(r1 - r2), small).otherwise(lens)


def point_to_grid(layer: Layer, interval: float, radius: float | None = None, calc: str | None = None, least: float = 0.05, bbox: list[float] | None = None, defs: dict | None = None) -> Layer:
    """Square cells with the weight of the points around: the share of a cell's circle that points' circles cover.

    Only cells with a weight above ``least`` are kept; ``calc`` runs over the points that touch a cell. Cells are
    found from each point (a fixed number per point) and aggregated with a partial step, no table of all cells is
    made. Bounds are widened to whole cells around their centre.
    """
    layer.need_geometry("point")
    b = bbox or layer_bounds(layer)
    r = radius or interval * math.sqrt(1 / math.pi)
    cell_r = interval * math.sqrt(1 / math.pi)
    if b is None:
        b = [0.0, 0.0, 0.0, 0.0]
    b = [b[0] - r, b[1] - r, b[2] + r, b[3] + r]
    nx, ny = max(1, math.ceil((b[2] - b[0]) / interval)), max(1, math.ceil((b[3] - b[1]) / interval))
    x0, y0 = (b[0] + b[2]) / 2 - nx * interval / 2, (b[1] + b[3]) / 2 - ny * interval / 2
    reach = r + cell_r
    pts = layer.df.withColumn("_p", F.explode(GEOM)).withColumns({"_x": F.col("_p")[0], "_y": F.col("_p")[1]}).drop("_p")
    span = lambda c, o, n: F.sequence(F.greatest(F.lit(0), F.floor((c - reach - o) / interval)).cast("int"), F.least(F.lit(n - 1), F.floor((c + reach - o) / interval)).cast("int"))
    df = pts.withColumn("_c", F.explode(span(F.col("_x"), x0, nx))).withColumn("_r", F.explode(span(F.col("_y"), y0, ny)))
    dx, dy = F.col("_x") - (F.lit(x0) + (F.col("_c") + 0.5) * interval), F.col("_y") - (F.lit(y0) + (F.col("_r") + 0.5) * interval)
    df = df.withColumn("_w", circle_overlap(F.sqrt(dx * dx + dy * dy), r, cell_r) / (interval * interval)).where(F.col("_w") > 0)
    df = df.withColumn("_cell", (F.col("_r").cast("long") * nx + F.col("_c")).cast("long"))
    plan, outputs = compiled(calc, translator(layer, defs), point=True) if calc else (Plan(), [])
    cells = grouped(df, ["_cell"], plan, {"weight": F.sum("_w")}).where(F.col("weight") > least)
    cx, cy = F.lit(x0) + (F.col("_cell") % nx) * interval, F.lit(y0) + F.floor(F.col("_cell") / nx) * interval
    ring = F.array(*[F.array(cx + a, cy + c) for a, c in ((0.0, 0.0), (0.0, interval), (interval, interval), (interval, 0.0), (0.0, 0.0))])
    return Layer(cells.select(F.col("_cell").alias(FID), F.array(ring).alias(GEOM), F.col("_cell").alias("id"), "weight", *[v.col.alias(n) for n, v in outputs]), layer.name, "polygon", layer.crs)


def dissolve_points(layer: Layer, fields: list[str] | None = None, weight: str | None = None, planar: bool = False, calc: str | None = None, copy_fields: list[str] | None = None, group: bool = False, defs: dict | None = None) -> Layer:
    """The (weighted) centroid of each group of points, on the sphere for degrees unless ``planar``.

    Null points and weights that aren't positive are left out; multipoints are an error where centroids are asked
    for. ``group`` collects the points of a group as one multipoint instead.
    """
    layer.need_geometry("point")
    from geolathe.operators.table import dissolve

    keys = fields or []
    table = dissolve(layer, keys, calc, copy_fields=copy_fields, defs=defs)
    if group:
        parts = F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col(GEOM).isNotNull(), F.struct(FID, GEOM)))), lambda s: s[GEOM]))
        shapes = layer.df.groupBy(*keys).agg(F.min(FID).alias("_g"), parts.alias(GEOM))
    else:
        w = translator(layer, defs).column(weight).col.cast("double") if weight else F.lit(1.0)
        p = F.when(F.size(GEOM) > 1, F.raise_error(F.lit("multipoints can't be dissolved to a centroid"))).otherwise(F.get(GEOM, F.lit(0)))
        good = F.col(GEOM).isNotNull() & (w > 0)
        df = layer.df.withColumn("_w", F.when(good, w)).withColumn("_pt", p)
        x, y, w = F.col("_pt")[0], F.col("_pt")[1], F.col("_w")
        if layer.lat_long and not planar:
            lng, lat = F.radians(x), F.radians(y)
            sums = df.groupBy(*keys).agg(F.min(FID).alias("_g"), *[F.sum(w * v).alias(n) for n, v in (("_sx", F.cos(lat) * F.cos(lng)), ("_sy", F.cos(lat) * F.sin(lng)), ("_sz", F.sin(lat)))])
            cx = F.degrees(F.atan2("_sy", "_sx"))
            cy = F.degrees(F.atan2(F.col("_sz"), F.sqrt(F.col("_sx") * F.col("_sx") + F.col("_sy") * F.col("_sy"))))
            has = F.col("_sx").isNotNull()
        else:
            sums = df.groupBy(*keys).agg(F.min(FID).alias("_g"), F.sum(w * x).alias("_sx"), F.sum(w * y).alias("_sy"), F.sum(F.when(x.isNotNull(), w)).alias("_sw"))
            cx, cy, has = F.col("_sx") / F.col("_sw"), F.col("_sy") / F.col("_sw"), F.col("_sw").isNotNull()
        shapes = sums.select("_g", F.when(has, F.array(F.array(cx, cy))).alias(GEOM))
    out = table.df.join(shapes.select("_g", GEOM), table.df[FID] == F.col("_g"), "left").drop("_g")
    return layer.with_df(out)


def affine(layer: Layer, shift: tuple[float, float] = (0.0, 0.0), scale: float = 1.0, rotate: float = 0.0, anchor: tuple[float, float] | None = None, where: str | None = None, defs: dict | None = None) -> Layer:
    """Scales and turns (degrees, counter-clockwise) about the anchor, by default the middle of the bounds, and shifts."""
    if anchor is None:
        b = layer_bounds(layer) or [0.0, 0.0, 0.0, 0.0]
        anchor = ((b[0] + b[2]) / 2, (b[1] + b[3]) / 2)
    ax, ay = anchor
    a, b_ = scale * math.cos(math.radians(rotate)), -scale * math.sin(math.radians(rotate))
    move = lambda p: F.array(a * (p[0] - ax) + b_ * (p[1] - ay) + (ax + shift[0]), -b_ * (p[0] - ax) + a * (p[1] - ay) + (ay + shift[1]))
    g = F.col(GEOM)
    moved = F.transform(g, move) if layer.geometry_type == "point" else F.transform(g, lambda part: F.transform(part, move))
    return layer.with_df(layer.df.withColumn(GEOM, F.when(strict(layer, where, defs), moved).otherwise(g) if where else moved))


def clip_points(layer: Layer, bbox: list[float], erase: bool = False) -> Layer:
    """Points inside of the box (edges count), part by part; emptied features become null and are dropped."""
    x0, y0, x1, y1 = bbox
    inside = lambda p: p[0].between(x0, x1) & p[1].between(y0, y1)
    kept = F.filter(GEOM, (lambda p: ~inside(p)) if erase else inside)
    return layer.with_df(layer.df.withColumn(GEOM, kept).where(F.size(GEOM) > 0))


def clip_points_by(points: Layer, polygons: Layer, erase: bool = False) -> Layer:
    """Points inside (or outside) of any polygon; part by part, features without parts left are dropped."""
    from geolathe.operators.proximity import containing

    parts = points.df.select(FID, F.posexplode(GEOM).alias("_i", "_p")).withColumn("_k", F.struct(FID, "_i"))
    flat = parts.select(F.to_json("_k").alias("_k"), F.col("_p")[0].alias("_x"), F.col("_p")[1].alias("_y"), FID, "_i", "_p")
    shapes = polygons.df.select(F.col(FID).alias("_r"), F.when(F.col(GEOM).isNotNull(), F.array(F.col(GEOM))).alias("_shape"))
    inside = containing(flat, "_k", "_x", "_y", shapes, "_r", "_shape").select(F.col("id").alias("_k")).distinct()
    kept = flat.join(inside, "_k", "left_anti" if erase else "left_semi")
    back = kept.groupBy(FID).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_p"))), lambda s: s["_p"]).alias(GEOM))
    return points.with_df(points.df.drop(GEOM).join(back, FID))


def point_buffer(layer: Layer, radius: float | str, vertices_: int = 72, defs: dict | None = None) -> Layer:
    """Circles around points: in metres on the sphere for degrees, else in the layer's units. Radii may be expressions."""
    layer.need_geometry("point")
    r = F.lit(float(radius)) if isinstance(radius, (int, float)) else translator(layer, defs).column(radius).col.cast("double")
    steps = F.sequence(F.lit(0), F.lit(vertices_))
    turn = lambda i: -(i % vertices_) * (2 * math.pi / vertices_)

    def circle(p: F.Column) -> F.Column:
        if not layer.lat_long:
            return F.transform(steps, lambda i: F.array(p[0] + r * F.cos(turn(i)), p[1] + r * F.sin(turn(i))))
        d, lat, lng = r / G.RADIUS, F.radians(p[1]), F.radians(p[0])

        def at(i: F.Column) -> F.Column:
            bearing = -turn(i)
            y = F.asin(F.sin(lat) * F.cos(d) + F.cos(lat) * F.sin(d) * F.cos(bearing))
            x = lng + F.atan2(F.sin(bearing) * F.sin(d) * F.cos(lat), F.cos(d) - F.sin(lat) * F.sin(y))
            return F.array(F.degrees(x), F.degrees(y))

        return F.transform(steps, at)

    shape = F.transform(GEOM, circle)
    return layer.with_df(layer.df.withColumn(GEOM, F.when(r > 0, shape)), geometry_type="polygon")


#: Corners of regular symbols.
SIDES = {"triangle": 3, "square": 4, "pentagon": 5, "hexagon": 6, "octagon": 8, "circle": 72}


def symbols(layer: Layer, kind: str = "circle", radius: float | str = 5.0, sides: int | None = None, rotation: float | str = 0.0, scale: float = 1.0, points: int = 5, point_ratio: float = 0.5, defs: dict | None = None) -> Layer:
    """Polygons around points, in the layer's units: regular ones, or stars whose inner corners lie at a share of the radius.

    Radius and rotation (degrees, clockwise) may be expressions; the first corner points up. Symbols without a positive
    radius are null.
    """
    layer.need_geometry("point")
    column = lambda v: F.lit(float(v)) if isinstance(v, (int, float)) else translator(layer, defs).column(v).col.cast("double")
    r, turn = column(radius) * float(scale), column(rotation)
    star = kind == "star"
    n = 2 * points if star else sides or SIDES.get(kind, 0)
    if n < 3:
        raise LayerError(f"unknown symbol {kind}")

    def corner(p: F.Column, i: int) -> F.Column:
        a = F.radians(F.lit(90.0 - 360.0 * (i % n) / n) - turn)
        own = r * (point_ratio if star and i % 2 else 1.0)
        return F.array(p[0] + own * F.cos(a), p[1] + own * F.sin(a))

    shape = F.transform(GEOM, lambda p: F.array(*[corner(p, i) for i in range(n + 1)]))
    return layer.with_df(layer.df.withColumn(GEOM, F.when(r > 0, shape)), geometry_type="polygon")


def frame(spark: SparkSession, bbox: list[float], width: float | None = None, height: float | None = None, aspect_ratio: float | None = None, offset: float = 0.0) -> Layer:
    """A rectangle around a map, with its size in pixels (800 wide unless said otherwise); the box is widened to fit it."""
    x0, y0, x1, y1 = map(float, bbox)
    dx, dy = (x1 - x0) * offset, (y1 - y0) * offset
    x0, y0, x1, y1 = x0 - dx, y0 - dy, x1 + dx, y1 + dy
    if not x1 > x0 or not y1 > y0:
        raise LayerError("a frame needs a box with a width and a height")
    width = 800.0 if not width and not height else width
    if aspect_ratio:
        width, height = width or height * aspect_ratio, height or width / aspect_ratio  # type: ignore[operator]
    own = (x1 - x0) / (y1 - y0)
    width, height = width or height * own, height or width / own  # type: ignore[operator]
    more = (y1 - y0) * width / height - (x1 - x0)
    if more > 0:
        x0, x1 = x0 - more / 2, x1 + more / 2
    else:
        more = (x1 - x0) * height / width - (y1 - y0)
        y0, y1 = y0 - more / 2, y1 + more / 2
    made = rectangle(spark, [x0, y0, x1, y1], "frame")
    return made.with_df(made.df.withColumns({"type": F.lit("frame"), "width": F.lit(float(width)), "height": F.lit(float(height))}))


def rectangles(layer: Layer, offset: float = 0.0) -> Layer:
    """The bounds of each feature as a polygon, widened by ``offset``."""
    b = G.bounds(F.col(GEOM), layer.geometry_type == "point")
    x0, y0, x1, y1 = b["xmin"] - offset, b["ymin"] - offset, b["xmax"] + offset, b["ymax"] + offset
    ring = F.array(*[F.array(x, y) for x, y in ((x0, y0), (x0, y1), (x1, y1), (x1, y0), (x0, y0))])
    return layer.with_df(layer.df.withColumn(GEOM, F.when(b["xmin"].isNotNull(), F.array(ring))), geometry_type="polygon")


def rectangle(spark: SparkSession, bbox: list[float], name: str = "rectangle") -> Layer:
    x0, y0, x1, y1 = map(float, bbox)
    return Layer(spark.createDataFrame([(0, [[[x0, y0], [x0, y1], [x1, y1], [x1, y0], [x0, y0]]])], f"{FID} bigint, {GEOM} array<array<array<double>>>"), name, "polygon")


def graticule(spark: SparkSession, interval: float = 10.0) -> Layer:
    """Meridians and parallels every ``interval`` degrees, a point per degree."""
    n, m = int(360 / interval) + 1, int(180 / interval) - 1
    i = F.col("id")
    meridian = F.transform(F.sequence(F.lit(-90), F.lit(90)), lambda y: F.array((i * interval - 180).cast("double"), y.cast("double")))
    parallel = F.transform(F.sequence(F.lit(-180), F.lit(180)), lambda x: F.array(x.cast("double"), ((i - n + 1) * interval - 90).cast("double")))
    df = spark.range(n + m).select(i.alias(FID), F.when(i < n, F.lit("meridian")).otherwise("parallel").alias("type"), F.when(i < n, i * interval - 180).otherwise((i - n + 1) * interval - 90).cast("double").alias("value"), F.array(F.when(i < n, meridian).otherwise(parallel)).alias(GEOM))
    return Layer(df, "graticule", "polyline", "wgs84")
