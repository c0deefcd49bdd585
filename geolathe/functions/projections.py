"""Map projections on the WGS84 ellipsoid (or the sphere, where that's the custom), forward and inverse, in metres.

All work on arrays of coordinates at once (numpy), or on single numbers. Places that a projection can't show are NaN.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

# The WGS84 ellipsoid.
A, F_ = 6378137.0, 1 / 298.257223563
E2 = F_ * (2 - F_)
E = math.sqrt(E2)
N = F_ / (2 - F_)
# Series of the transverse Mercator projection in the third flattening.
ALPHA = [N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16, 13 * N**2 / 48 - 3 * N**3 / 5, 61 * N**3 / 240]
BETA = [N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96, N**2 / 48 + N**3 / 15, 17 * N**3 / 480]
RECTIFYING = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64)

#: Names of projections and what stands for them.
ALIASES = {
    "wgs84": "+proj=longlat", "longlat": "+proj=longlat", "webmercator": "+proj=webmerc", "mercator": "+proj=merc", "merc": "+proj=merc",
    "eqc": "+proj=eqc", "albersusa": "+proj=aea +lat_1=29.5 +lat_2=45.5 +lat_0=37.5 +lon_0=-96", "aea": "+proj=aea +lat_1=29.5 +lat_2=45.5 +lat_0=37.5 +lon_0=-96",
    "lcc": "+proj=lcc +lat_1=33 +lat_2=45 +lat_0=39 +lon_0=-96", "laea": "+proj=laea", "robin": "+proj=robin", "sinu": "+proj=sinu", "moll": "+proj=moll",
    "miller": "+proj=mill", "gall": "+proj=gall", "natearth": "+proj=natearth", "equalearth": "+proj=eqearth", "cea": "+proj=cea",
    "EPSG:4326": "+proj=longlat", "EPSG:3857": "+proj=webmerc",
}

Map = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Projection:
    """Degrees to metres and back."""

    definition: str
    forward: Map
    inverse: Map


def parameters(definition: str) -> dict[str, str]:
    return dict((p.lstrip("+").split("=", 1) + [""])[:2] for p in definition.split() if p.startswith("+"))


def projection(name: str) -> Projection:
    """A projection by alias, by EPSG code of a UTM zone, or by ``+proj`` parameters."""
    m = re.fullmatch(r"EPSG:32([67])(\d\d)", name, re.I)
    text = f"+proj=utm +zone={int(m.group(2))}" + " +south" * (m.group(1) == "7") if m else ALIASES.get(name, ALIASES.get(name.lower(), name))
    p = parameters(text)
    kind = p.get("proj", "")
    g = lambda k, d=0.0: float(p[k]) if k in p else d
    makers = {"longlat": _longlat, "latlong": _longlat, "webmerc": _webmerc, "merc": _merc, "eqc": _eqc, "utm": _utm, "tmerc": _tmerc, "lcc": _lcc, "aea": _aea, "laea": _laea, "sinu": _sinu, "moll": _moll, **STRAIGHT, **ROUND}
    if kind not in makers:
        raise ValueError(f"unknown projection {name!r}")
    f, i = makers[kind](g, p)
    x0, y0 = (g("x_0", 500000.0), g("y_0", 10000000.0 if "south" in p else 0.0)) if kind == "utm" else (g("x_0"), g("y_0"))
    if kind in ("longlat", "latlong"):
        return Projection(text, f, i)
    return Projection(text, lambda x, y: tuple(a + b for a, b in zip(f(x, y), (x0, y0))), lambda x, y: i(x - x0, y - y0))  # type: ignore[return-value,arg-type]


def _longlat(g, p):  # noqa: ANN001, ANN202
    same = lambda x, y: (x, y)
    return same, same


def _webmerc(g, p):  # noqa: ANN001, ANN202
    lon0 = g("lon_0")
    return (
        lambda x, y: (A * np.radians(x - lon0), A * np.log(np.tan(math.pi / 4 + np.radians(np.clip(y, -89.99, 89.99)) / 2))),
        lambda x, y: (np.degrees(x / A) + lon0, np.degrees(2 * np.arctan(np.exp(y / A)) - math.pi / 2)),
    )


def _isometric(lat: float) -> float:
    s = np.sin(lat)
    return np.arctanh(s) - E * np.arctanh(E * s)


def _latitude(psi: float) -> float:
    lat = np.arcsin(np.tanh(psi))
    for _ in range(8):
        lat = np.arcsin(np.tanh(psi + E * np.arctanh(E * np.sin(lat))))
    return lat


def _merc(g, p):  # noqa: ANN001, ANN202
    lon0, ts = g("lon_0"), np.radians(g("lat_ts"))
    k = np.cos(ts) / np.sqrt(1 - E2 * np.sin(ts) ** 2) * g("k", 1.0)
    return (
        lambda x, y: (A * k * np.radians(x - lon0), A * k * _isometric(np.radians(np.clip(y, -89.99, 89.99)))),
        lambda x, y: (np.degrees(x / A / k) + lon0, np.degrees(_latitude(y / A / k))),
    )


def _eqc(g, p):  # noqa: ANN001, ANN202
    lon0, c = g("lon_0"), np.cos(np.radians(g("lat_ts")))
    return lambda x, y: (A * c * np.radians(x - lon0), A * np.radians(y)), lambda x, y: (np.degrees(x / A / c) + lon0, np.degrees(y / A))


def _utm(g, p):  # noqa: ANN001, ANN202
    zone = int(p.get("zone", 31))
    return _tmerc(lambda k, d=0.0: {"lon_0": zone * 6 - 183.0, "k": 0.9996}.get(k, d), p)


def _tmerc(g, p):  # noqa: ANN001, ANN202
    lon0, lat0, k = g("lon_0"), np.radians(g("lat_0")), g("k", g("k_0", 1.0))

    def raw(x: float, y: float) -> tuple[float, float]:
        lam = np.radians(x - lon0)
        t = np.sinh(_isometric(np.radians(y)))
        xi, eta = np.arctan2(t, np.cos(lam)), np.arcsinh(np.sin(lam) / np.hypot(t, np.cos(lam)))
        e = eta + sum(a * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, a in enumerate(ALPHA, 1))
        n = xi + sum(a * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, a in enumerate(ALPHA, 1))
        return k * RECTIFYING * e, k * RECTIFYING * n

    base = raw(lon0, np.degrees(lat0))[1] if lat0 else 0.0

    def inverse(x: float, y: float) -> tuple[float, float]:
        xi, eta = (y + base) / (k * RECTIFYING), x / (k * RECTIFYING)
        xp = xi - sum(b * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, b in enumerate(BETA, 1))
        ep = eta - sum(b * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, b in enumerate(BETA, 1))
        conformal = np.arcsin(np.sin(xp) / np.cosh(ep))
        return np.degrees(np.arctan2(np.sinh(ep), np.cos(xp))) + lon0, np.degrees(_latitude(np.arctanh(np.sin(conformal))))

    return lambda x, y: (raw(x, y)[0], raw(x, y)[1] - base), inverse


def _lcc(g, p):  # noqa: ANN001, ANN202
    l1, l2 = np.radians(g("lat_1")), np.radians(g("lat_2", g("lat_1")))
    l0, lon0 = np.radians(g("lat_0")), g("lon_0")
    m = lambda s: np.cos(s) / np.sqrt(1 - E2 * np.sin(s) ** 2)
    n = np.sin(l1) if abs(l1 - l2) < 1e-12 else (np.log(m(l1)) - np.log(m(l2))) / (_isometric(l2) - _isometric(l1))
    c = A * m(l1) * np.exp(n * _isometric(l1)) / n
    r0 = c * np.exp(-n * _isometric(l0))

    def inverse(x: float, y: float) -> tuple[float, float]:
        sign = 1 if n > 0 else -1
        r = sign * np.hypot(x, r0 - y)
        t = np.arctan2(sign * x, sign * (r0 - y))
        return np.degrees(t / n) + lon0, np.degrees(_latitude(-np.log(r / c) / n))

    def forward(x: float, y: float) -> tuple[float, float]:
        r, t = c * np.exp(-n * _isometric(np.radians(np.clip(y, -89.99, 89.99)))), n * np.radians(x - lon0)
        return r * np.sin(t), r0 - r * np.cos(t)

    return forward, inverse


def _q(lat: float) -> float:
    s = np.sin(lat)
    return (1 - E2) * (s / (1 - E2 * s * s) + np.arctanh(E * s) / E)


def _q_latitude(q: float) -> float:
    lat = np.arcsin(np.clip(q / 2, -1.0, 1.0))
    for _ in range(12):
        s, c = np.sin(lat), np.cos(lat)
        flat = np.abs(c) < 1e-12
        lat = lat + np.where(flat, 0.0, (1 - E2 * s * s) ** 2 / (2 * np.where(flat, 1.0, c))) * (q / (1 - E2) - s / (1 - E2 * s * s) - np.arctanh(E * s) / E)
    return lat


def _aea(g, p):  # noqa: ANN001, ANN202
    l1, l2, l0, lon0 = np.radians(g("lat_1")), np.radians(g("lat_2", g("lat_1"))), np.radians(g("lat_0")), g("lon_0")
    m2 = lambda s: np.cos(s) ** 2 / (1 - E2 * np.sin(s) ** 2)
    n = np.sin(l1) if abs(l1 - l2) < 1e-12 else (m2(l1) - m2(l2)) / (_q(l2) - _q(l1))
    c = m2(l1) + n * _q(l1)
    rho = lambda lat: A * np.sqrt(np.maximum(0.0, c - n * _q(lat))) / n
    r0 = rho(l0)

    def inverse(x: float, y: float) -> tuple[float, float]:
        sign = 1 if n > 0 else -1
        r, t = np.hypot(x, r0 - y), np.arctan2(sign * x, sign * (r0 - y))
        return np.degrees(t / n) + lon0, np.degrees(_q_latitude((c - (r * n / A) ** 2) / n))

    def forward(x: float, y: float) -> tuple[float, float]:
        r, t = rho(np.radians(y)), n * np.radians(x - lon0)
        return r * np.sin(t), r0 - r * np.cos(t)

    return forward, inverse


def _laea(g, p):  # noqa: ANN001, ANN202
    l0, lon0 = np.radians(g("lat_0")), g("lon_0")

    def forward(x: float, y: float) -> tuple[float, float]:
        a, b = np.radians(x - lon0), np.radians(y)
        k = np.sqrt(2 / np.maximum(1e-12, 1 + np.sin(l0) * np.sin(b) + np.cos(l0) * np.cos(b) * np.cos(a)))
        return A * k * np.cos(b) * np.sin(a), A * k * (np.cos(l0) * np.sin(b) - np.sin(l0) * np.cos(b) * np.cos(a))

    def inverse(x: float, y: float) -> tuple[float, float]:
        r = np.maximum(np.hypot(x, y), 1e-12)
        c = 2 * np.arcsin(np.minimum(1.0, r / (2 * A)))
        lat = np.arcsin(np.clip(np.cos(c) * np.sin(l0) + y * np.sin(c) * np.cos(l0) / r, -1.0, 1.0))
        return lon0 + np.degrees(np.arctan2(x * np.sin(c), r * np.cos(l0) * np.cos(c) - y * np.sin(l0) * np.sin(c))), np.degrees(lat)

    return forward, inverse


def _sinu(g, p):  # noqa: ANN001, ANN202
    lon0 = g("lon_0")
    return lambda x, y: (A * np.radians(x - lon0) * np.cos(np.radians(y)), A * np.radians(y)), lambda x, y: (lon0 + np.degrees(x / A / np.maximum(1e-12, np.cos(y / A))), np.degrees(y / A))


def _moll(g, p):  # noqa: ANN001, ANN202
    lon0, r2 = g("lon_0"), np.sqrt(2)

    def forward(x: float, y: float) -> tuple[float, float]:
        lat = np.radians(y)
        t = lat
        for _ in range(30):
            d = 2 + 2 * np.cos(2 * t)
            flat = np.abs(d) < 1e-12
            t = t - np.where(flat, 0.0, 2 * t + np.sin(2 * t) - math.pi * np.sin(lat)) / np.where(flat, 1.0, d)
        return A * 2 * r2 / math.pi * np.radians(x - lon0) * np.cos(t), A * r2 * np.sin(t)

    def inverse(x: float, y: float) -> tuple[float, float]:
        t = np.arcsin(np.clip(y / A / r2, -1.0, 1.0))
        return lon0 + np.degrees(math.pi * x / (2 * A * r2 * np.maximum(1e-12, np.cos(t)))), np.degrees(np.arcsin(np.clip((2 * t + np.sin(2 * t)) / math.pi, -1.0, 1.0)))

    return forward, inverse


# The tables and series of projections that are defined by them.
ROBINSON_X = [1.0, 0.9986, 0.9954, 0.99, 0.9822, 0.973, 0.96, 0.9427, 0.9216, 0.8962, 0.8679, 0.835, 0.7986, 0.7597, 0.7186, 0.6732, 0.6213, 0.5722, 0.5322]
ROBINSON_Y = [0.0, 0.062, 0.124, 0.186, 0.248, 0.31, 0.372, 0.434, 0.4958, 0.5571, 0.6176, 0.6769, 0.7346, 0.7903, 0.8435, 0.8936, 0.9394, 0.9761, 1.0]
NATURAL_X, NATURAL_Y = (0.8707, -0.131979, -0.013791, 0.003971, -0.001529), (1.007226, 0.015085, -0.044475, 0.028874, -0.005916)
EQUAL_EARTH = (1.340264, -0.081106, 0.000893, 0.003796)


def _through(table: list[float], even: bool):  # noqa: ANN202
    """A cubic through the four values of a table (one for every five degrees) around each latitude in radians."""
    v = np.array([table[1] if even else -table[1], *table, 2 * table[-1] - table[-2]])

    def at(lat: np.ndarray) -> np.ndarray:
        d = np.abs(np.degrees(lat)) / 5
        i = np.clip(np.floor(d).astype(int), 0, len(table) - 2)
        t = d - i
        a, b, c, e = v[i], v[i + 1], v[i + 2], v[i + 3]
        y = b + t / 2 * (c - a + t * (2 * a - 5 * b + 4 * c - e + t * (3 * (b - c) + e - a)))
        return y if even else np.sign(lat) * y

    return at


def _along(fx: Callable, fy: Callable):  # noqa: ANN202
    """A projection of the sphere with straight parallels: x is the longitude times ``fx`` of the latitude, y is ``fy``
    of it, which rises with it; the inverse halves the latitudes that are left."""

    def make(g, p):  # noqa: ANN001, ANN202
        lon0 = g("lon_0")
        x_of, y_of = (lambda lat: fx(lat, g)), (lambda lat: fy(lat, g))

        def inverse(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            low, high = np.full(np.shape(y), -math.pi / 2), np.full(np.shape(y), math.pi / 2)
            for _ in range(60):
                mid = (low + high) / 2
                under = y_of(mid) < y / A
                low, high = np.where(under, mid, low), np.where(under, high, mid)
            lat = (low + high) / 2
            return np.degrees(x / A / np.maximum(1e-12, x_of(lat))) + lon0, np.degrees(lat)

        return lambda x, y: (A * x_of(np.radians(y)) * np.radians(x - lon0), A * y_of(np.radians(y))), inverse

    return make


def _natural_y(t: np.ndarray, g: Callable) -> np.ndarray:
    b = NATURAL_Y
    return t * (b[0] + t**2 * (b[1] + t**6 * (b[2] + b[3] * t**2 + b[4] * t**4)))


def _equal_earth(lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, t = EQUAL_EARTH, np.arcsin(math.sqrt(3) / 2 * np.sin(lat))
    x = 2 * math.sqrt(3) * np.cos(t) / (3 * (9 * a[3] * t**8 + 7 * a[2] * t**6 + 3 * a[1] * t**2 + a[0]))
    return x, a[3] * t**9 + a[2] * t**7 + a[1] * t**3 + a[0] * t


STRAIGHT = {
    "mill": _along(lambda t, g: np.ones(np.shape(t)), lambda t, g: 1.25 * np.log(np.tan(math.pi / 4 + 0.4 * t))),
    "gall": _along(lambda t, g: np.full(np.shape(t), math.sqrt(0.5)), lambda t, g: (1 + math.sqrt(0.5)) * np.tan(t / 2)),
    "cea": _along(lambda t, g: np.full(np.shape(t), np.cos(np.radians(g("lat_ts")))), lambda t, g: np.sin(t) / np.cos(np.radians(g("lat_ts")))),
    "robin": _along(lambda t, g, f=_through(ROBINSON_X, True): 0.8487 * f(t), lambda t, g, f=_through(ROBINSON_Y, False): 1.3523 * f(t)),
    "natearth": _along(lambda t, g: NATURAL_X[0] + t**2 * (NATURAL_X[1] + t**2 * (NATURAL_X[2] + t**6 * (NATURAL_X[3] + t**2 * NATURAL_X[4]))), _natural_y),
    "eqearth": _along(lambda t, g: _equal_earth(t)[0], lambda t, g: _equal_earth(t)[1]),
}


def _azimuthal(scale: Callable, angle: Callable):  # noqa: ANN202
    """A projection of the sphere around a centre: ``scale`` of the cosine of the distance, and back by ``angle``."""

    def make(g, p):  # noqa: ANN001, ANN202
        l0, lon0 = np.radians(g("lat_0")), g("lon_0")

        def forward(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            a, b = np.radians(x - lon0), np.radians(y)
            cos_c = np.sin(l0) * np.sin(b) + np.cos(l0) * np.cos(b) * np.cos(a)
            k = A * scale(np.clip(cos_c, -1.0, 1.0))
            return k * np.cos(b) * np.sin(a), k * (np.cos(l0) * np.sin(b) - np.sin(l0) * np.cos(b) * np.cos(a))

        def inverse(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            r = np.maximum(np.hypot(x, y), 1e-12)
            c = angle(r / A)
            lat = np.arcsin(np.clip(np.cos(c) * np.sin(l0) + y * np.sin(c) * np.cos(l0) / r, -1.0, 1.0))
            return lon0 + np.degrees(np.arctan2(x * np.sin(c), r * np.cos(l0) * np.cos(c) - y * np.sin(l0) * np.sin(c))), np.degrees(lat)

        return forward, inverse

    return make


ROUND = {
    "ortho": _azimuthal(lambda c: np.where(c >= 0, 1.0, np.nan), lambda r: np.arcsin(np.minimum(1.0, r))),
    "gnom": _azimuthal(lambda c: np.where(c > 1e-9, 1 / np.where(c > 1e-9, c, 1.0), np.nan), np.arctan),
    "stere": _azimuthal(lambda c: 2 / np.maximum(1e-12, 1 + c), lambda r: 2 * np.arctan(r / 2)),
    "aeqd": _azimuthal(lambda c: np.where(c < 1 - 1e-15, np.arccos(c) / np.maximum(1e-15, np.sqrt(np.maximum(0.0, 1 - c * c))), 1.0), lambda r: r),
}


def between(source: str, target: str) -> Map:
    """Coordinates of one system in another."""
    a, b = projection(source), projection(target)
    return lambda x, y: b.forward(*a.inverse(x, y))
