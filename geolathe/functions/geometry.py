"""Measures of geometries as column expressions: area, length, centroid, bounds, distances."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Equatorial radius that spherical measures use, in metres.
RADIUS = 6378137.0


def segments(ring: Column, f: Callable[[Column, Column], Column]) -> Column:
    """``f(a, b)`` for each two neighbouring points of a part."""
    n = F.size(ring)
    return F.when(n < 2, F.array().cast("array<double>")).otherwise(F.zip_with(F.slice(ring, 1, F.greatest(n - 1, F.lit(0))), F.slice(ring, 2, F.greatest(n - 1, F.lit(0))), f))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def over_parts(parts: Column, f: Callable[[Column], Column]) -> Column:
    """Sum of a measure over the parts; null for null geometry."""
    return F.when(parts.isNotNull(), total(F.transform(parts, f)))


def ring_area(ring: Column) -> Column:
    """Signed planar area, positive for clockwise rings; computed about the first point."""
    first = F.get(ring, F.lit(0))
    x0, y0 = first[0], first[1]
    return total(segments(ring, lambda a, b: (b[0] - a[0]) * ((a[1] - y0) + (b[1] - y0)))) / 2


def ring_sphere_area(ring: Column) -> Column:
    """Signed area on the sphere in square metres of a ring in degrees, positive for clockwise rings."""
    part = lambda a, b: F.radians(b[0] - a[0]) * (2 + F.sin(F.radians(a[1])) + F.sin(F.radians(b[1])))
    return total(segments(ring, part)) * (RADIUS * RADIUS / 2)


def area(parts: Column, sphere: bool = False) -> Column:
    """Area of a polygon: outer rings count positive, holes negative."""
    return over_parts(parts, ring_sphere_area if sphere else ring_area)


def haversine(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    h = F.pow(F.sin(F.radians(by - ay) / 2), 2) + F.cos(F.radians(ay)) * F.cos(F.radians(by)) * F.pow(F.sin(F.radians(bx - ax) / 2), 2)
    return F.lit(2 * RADIUS) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def distance(ax: Column, ay: Column, bx: Column, by: Column, sphere: bool = False) -> Column:
    return haversine(ax, ay, bx, by) if sphere else F.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay))


def part_length(part: Column, sphere: bool = False) -> Column:
    return total(segments(part, lambda a, b: distance(a[0], a[1], b[0], b[1], sphere)))


def length(parts: Column, sphere: bool = False) -> Column:
    """Length of lines, perimeter of polygons."""
    return over_parts(parts, lambda p: part_length(p, sphere))


def compactness(parts: Column, sphere: bool = False) -> Column:
    p = length(parts, sphere)
    return F.when(p > 0, F.lit(4 * 3.141592653589793) * F.abs(area(parts, sphere)) / (p * p)).otherwise(F.lit(0.0))


def coordinates(geom: Column, point: bool) -> tuple[Column, Column]:
    """Arrays of all x and all y of a geometry."""
    flat = geom if point else F.flatten(geom)
    return F.transform(flat, lambda p: p[0]), F.transform(flat, lambda p: p[1])


def bounds(geom: Column, point: bool) -> dict[str, Column]:
    xs, ys = coordinates(geom, point)
    return {"xmin": F.array_min(xs), "ymin": F.array_min(ys), "xmax": F.array_max(xs), "ymax": F.array_max(ys)}


def largest_ring(parts: Column) -> Column:
    """The part with the largest area."""
    return F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.get(parts, F.lit(0)), lambda best, r: F.when(F.abs(ring_area(r)) > F.abs(ring_area(best)), r).otherwise(best))


def centroid(parts: Column) -> tuple[Column, Column]:
    """Area centroid of the largest ring (holes are left out), in planar coordinates."""
    ring = largest_ring(parts)
    first = F.get(ring, F.lit(0))
    x0, y0 = first[0], first[1]
    cross = lambda a, b: (a[0] - x0) * (b[1] - y0) - (b[0] - x0) * (a[1] - y0)
    doubled = total(segments(ring, cross))
    cx = total(segments(ring, lambda a, b: cross(a, b) * ((a[0] - x0) + (b[0] - x0))))
    cy = total(segments(ring, lambda a, b: cross(a, b) * ((a[1] - y0) + (b[1] - y0))))
    flat = F.when(doubled != 0, doubled)
    good = parts.isNotNull() & (F.size(parts) > 0)
    return F.when(good, F.coalesce(x0 + cx / (3 * flat), x0)), F.when(good, F.coalesce(y0 + cy / (3 * flat), y0))


def rounded(geom: Column, step: float, point: bool) -> Column:
    """Coordinates rounded to a multiple of ``step``."""
    k = 1 / step
    one = lambda p: F.transform(p, lambda v: F.floor(v * k + 0.5).cast("double") / k)
    return F.transform(geom, one) if point else F.transform(geom, lambda part: F.transform(part, one))
