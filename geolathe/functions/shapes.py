"""Geometry of single features in plain Python and numpy: what column expressions can't say.

Parts are lists of [x, y]; rings repeat their first point at the end. These functions are called on Arrow batches.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Callable

import numpy as np

from geolathe.functions.regions import Regions

Point = list[float]
Ring = list[Point]
RADIUS = 6378137.0


def ring_area(ring: Ring) -> float:
    """Signed area, positive for clockwise rings."""
    if len(ring) < 3:
        return 0.0
    a = np.asarray(ring, dtype=float)[:, :2] - ring[0][:2]
    return float(-0.5 * np.sum(a[:-1, 0] * a[1:, 1] - a[1:, 0] * a[:-1, 1]))


def closed(ring: Ring) -> Ring:
    return ring if not ring or ring[0] == ring[-1] else [*ring, ring[0]]


def in_ring(x: float, y: float, ring: Ring) -> bool:
    inside = False
    for (ax, ay, *_), (bx, by, *_) in zip(ring, ring[1:]):
        if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
            inside = not inside
    return inside


def nested(rings: list[Ring]) -> list[list[Ring]]:
    """Rings as polygons: every clockwise ring with the holes that lie in it and in no smaller one."""
    outer = [r for r in rings if ring_area(r) > 0]
    groups: list[list[Ring]] = [[r] for r in outer]
    for h in rings:
        if ring_area(h) < 0:
            around = [i for i, r in enumerate(outer) if in_ring(*_inside_near(h), r)]
            if around:
                groups[min(around, key=lambda i: ring_area(outer[i]))].append(h)
    return groups


def _inside_near(ring: Ring) -> tuple[float, float]:
    """A point just inside of a ring, near its first edge."""
    sign = 1 if ring_area(ring) > 0 else -1
    for (ax, ay, *_), (bx, by, *_) in zip(ring, ring[1:]):
        d = math.hypot(bx - ax, by - ay)
        if d:
            e = d * 1e-4
            x, y = (ax + bx) / 2 + sign * (by - ay) / d * e, (ay + by) / 2 - sign * (bx - ax) / d * e
            if in_ring(x, y, ring):
                return x, y
    return ring[0][0], ring[0][1]


def inner_point(rings: list[Ring]) -> Point | None:
    """A point well inside of the largest polygon: the middle of the widest stretch on some horizontal lines."""
    groups = [g for g in nested(rings) if g]
    if not groups:
        return None
    poly = max(groups, key=lambda g: ring_area(g[0]))
    ys = [p[1] for p in poly[0]]
    low, high = min(ys), max(ys)
    best: tuple[float, Point] | None = None
    for k in (0.5, 0.4, 0.6, 0.3, 0.7, 0.2, 0.8, 0.1, 0.9):
        y = low + (high - low) * k
        xs = sorted(ax + (y - ay) * (bx - ax) / (by - ay) for r in poly for (ax, ay, *_), (bx, by, *_) in zip(r, r[1:]) if (ay > y) != (by > y))
        for a, b in zip(xs[::2], xs[1::2]):
            score = (b - a) * (1 - abs(k - 0.5))
            if best is None or score > best[0]:
                best = (score, [(a + b) / 2, y])
    return best[1] if best else None


# --- simplification ------------------------------------------------------------------------------------------------


def _xyz(part: Ring, sphere: bool) -> np.ndarray:
    p = np.asarray(part, dtype=float)[:, :2]
    if not sphere:
        return p
    lng, lat = np.radians(p[:, 0]), np.radians(p[:, 1])
    return RADIUS * np.column_stack([np.cos(lat) * np.cos(lng), np.cos(lat) * np.sin(lng), np.sin(lat)])


def dp_thresholds(part: Ring, sphere: bool = False) -> list[float]:
    """For each vertex the interval below which it's dropped: its distance from the chord it first leaves."""
    p = _xyz(part, sphere)
    n = len(p)
    out = np.zeros(n)
    if n:
        out[[0, -1]] = np.inf
    stack = [(0, n - 1, np.inf)]
    while stack:
        a, b, limit = stack.pop()
        if b - a < 2:
            continue
        q = p[a + 1 : b]
        ab = p[b] - p[a]
        size = float(ab @ ab)
        t = np.clip(((q - p[a]) @ ab) / size, 0, 1) if size else np.zeros(len(q))
        d = np.linalg.norm(q - (p[a] + t[:, None] * ab), axis=1)
        i = int(np.argmax(d))
        limit = min(limit, float(d[i]))
        out[a + 1 + i] = limit
        stack += [(a, a + 1 + i, limit), (a + 1 + i, b, limit)]
    return out.tolist()


def visvalingam_thresholds(part: Ring, weighting: float = 0.7, sphere: bool = False) -> list[float]:
    """For each vertex the root of the effective (weighted) area of its triangle when it's dropped.

    The weight favours keeping smooth bends: sharp angles count less, by ``weighting`` (0: plain areas).
    """
    p = _xyz(part, sphere)
    n = len(p)
    out = [math.inf] * n
    if n < 3:
        return out

    def measure(a: int, b: int, c: int) -> float:
        u, v = p[a] - p[b], p[c] - p[b]
        uu, vv, uv = float(u @ u), float(v @ v), float(u @ v)
        area = 0.5 * math.sqrt(max(0.0, uu * vv - uv * uv))
        if weighting and uu and vv:
            area *= 1 - weighting * uv / math.sqrt(uu * vv)
        return area

    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    current = [0.0] * n
    heap = []
    for i in range(1, n - 1):
        current[i] = measure(i - 1, i, i + 1)
        heapq.heappush(heap, (current[i], i))
    highest = 0.0
    gone = [False] * n
    while heap:
        value, i = heapq.heappop(heap)
        if gone[i] or value != current[i]:
            continue
        gone[i] = True
        highest = max(highest, value)
        out[i] = math.sqrt(highest)
        a, c = before[i], after[i]
        after[a], before[c] = c, a
        for j in (a, c):
            if 0 < j < n - 1:
                current[j] = measure(before[j], j, after[j])
                heapq.heappush(heap, (current[j], j))
    return out


def kept(part: Ring, thresholds: list[float], interval: float) -> Ring:
    return [p for p, t in zip(part, thresholds) if t >= interval]


def split_at(ring: Ring, nodes: list[bool]) -> list[Ring]:
    """A ring or line cut at its nodes into arcs; a ring without nodes is one arc from its smallest point on."""
    is_ring = len(ring) > 3 and ring[0] == ring[-1]
    if is_ring:
        body, flags = ring[:-1], nodes[:-1]
        at = next((i for i, f in enumerate(flags) if f), None)
        if at is None:
            at = min(range(len(body)), key=lambda i: (body[i], i))
        body, flags = body[at:] + body[:at], flags[at:] + flags[:at]
        ring, nodes = [*body, body[0]], [*flags, True]
    arcs, begin = [], 0
    for i in range(1, len(ring)):
        if nodes[i] or i == len(ring) - 1:
            arcs.append(ring[begin : i + 1])
            begin = i
    return arcs


def by_arcs(ring: Ring, nodes: list[bool], change: Callable[[Ring], Ring]) -> Ring:
    """Applies ``change`` to the arcs of a part, each in one fixed direction, so neighbours get the same result."""
    out: Ring = []
    for arc in split_at(ring, nodes):
        flip = arc[-1] < arc[0] or (arc[0] == arc[-1] and len(arc) > 3 and arc[-2] < arc[1])
        new = change(arc[::-1] if flip else arc)
        new = new[::-1] if flip else new
        out += new if not out else new[1:]
    return out


# --- lines ---------------------------------------------------------------------------------------------------------


def hop(a: Point, b: Point, sphere: bool) -> float:
    if not sphere:
        return math.hypot(b[0] - a[0], b[1] - a[1])
    la, lb = math.radians(a[1]), math.radians(b[1])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * RADIUS * math.asin(math.sqrt(min(1.0, h)))


def between(a: Point, b: Point, t: float) -> Point:
    return [a[0] + (b[0] - a[0]) * t, a[1] + (b[1] - a[1]) * t]


def along(line: Ring, at: float, sphere: bool = False) -> Point:
    """The point a distance along a line."""
    for a, b in zip(line, line[1:]):
        d = hop(a, b, sphere)
        if d >= at and d:
            return between(a, b, at / d)
        at -= d
    return list(line[-1])


def line_length(line: Ring, sphere: bool = False) -> float:
    return sum(hop(a, b, sphere) for a, b in zip(line, line[1:]))


def densified(line: Ring, interval: float, sphere: bool = False) -> Ring:
    """Points added so that no segment is longer than the interval; on the sphere along great circles."""
    out = line[:1]
    for a, b in zip(line, line[1:]):
        n = math.ceil(hop(a, b, sphere) / interval - 1e-9)
        for i in range(1, n):
            out.append(_great(a, b, i / n) if sphere else between(a, b, i / n))
        out.append(b)
    return out


def _great(a: Point, b: Point, t: float) -> Point:
    va, vb = _xyz([a], True)[0], _xyz([b], True)[0]
    w = math.acos(max(-1.0, min(1.0, float(va @ vb) / RADIUS**2)))
    if not w:
        return list(a)
    v = (va * math.sin((1 - t) * w) + vb * math.sin(t * w)) / math.sin(w)
    return [math.degrees(math.atan2(v[1], v[0])), math.degrees(math.asin(max(-1.0, min(1.0, v[2] / RADIUS))))]


def dashes(line: Ring, dash: float, gap: float, scaled: bool = False, sphere: bool = False) -> list[Ring]:
    """Dashes along a line; with gaps it begins with half a gap. ``scaled`` fits a whole number of dashes."""
    total = line_length(line, sphere)
    if scaled and total > 0:
        n = max(1, round(total / (dash + gap)))
        k = min((total / (n * (dash + gap)), total / ((n + 1) * (dash + gap))), key=lambda q: abs(math.log(q)))
        dash, gap = dash * k, gap * k
    out, drawing, left = [], gap == 0, dash if gap == 0 else gap / 2
    part: Ring = [list(line[0])] if drawing and line else []
    for a, b in zip(line, line[1:]):
        d, done = hop(a, b, sphere), 0.0
        while d - done > left:
            done += left
            p = between(a, b, done / d)
            if drawing:
                out.append([*part, p])
            part = [p]
            drawing = not drawing if gap > 0 else True
            left = dash if drawing else gap
        left -= d - done
        if drawing:
            part.append(list(b))
    if drawing and len(part) > 1 and line_length(part, sphere) > 1e-3 * dash:
        out.append(part)
    return out


def smoothed(part: Ring, distance: float, sphere: bool = False) -> Ring:
    """A gaussian average along the line about every vertex (after densifying); end points of lines stay."""
    ring = len(part) > 3 and part[0] == part[-1]
    p = np.asarray(densified(part, max(distance / 2, 1e-12), sphere), dtype=float)[:, :2]
    step = np.array([hop(a, b, sphere) for a, b in zip(p.tolist(), p[1:].tolist())])
    s = np.concatenate([[0], np.cumsum(step)])
    total = s[-1]
    if not total or len(p) < 3:
        return part
    out = []
    sigma = distance / 2
    for i in range(len(p)):
        d = s - s[i]
        if ring:
            d = (d + total / 2) % total - total / 2
        w = np.exp(-0.5 * (d / sigma) ** 2)
        if ring:
            w[-1] = 0
        elif i in (0, len(p) - 1):
            w = (np.arange(len(p)) == i).astype(float)
        else:  # symmetric at the ends
            reach = min(s[i], total - s[i])
            w[np.abs(d) > reach] = 0
        out.append(((p * w[:, None]).sum(axis=0) / w.sum()).tolist())
    if ring:
        out[-1] = list(out[0])
    return out


# --- boxes ---------------------------------------------------------------------------------------------------------


def clip_ring(ring: Ring, box: tuple[float, float, float, float]) -> Ring:
    """A ring cut to a box, edge by edge; what is cut off follows the border."""
    out = ring[:-1] if ring and ring[0] == ring[-1] else list(ring)
    for axis, bound, sign in ((0, box[0], 1), (0, box[2], -1), (1, box[1], 1), (1, box[3], -1)):
        if not out:
            return []
        new = []
        for a, b in zip(out, out[1:] + out[:1]):
            ia, ib = sign * (a[axis] - bound) >= 0, sign * (b[axis] - bound) >= 0
            if ia != ib:
                lo, hi = sorted((a, b))
                t = (bound - lo[axis]) / (hi[axis] - lo[axis])
                p = between(lo, hi, t)
                p[axis] = bound
            if ia:
                new.append(a)
                if not ib:
                    new.append(p)
            elif ib:
                new.append(p)
        out = new
    done = closed([p for i, p in enumerate(out) if i == 0 or p != out[i - 1]])
    return done if len(done) > 3 and ring_area(done) else []


def clip_line(line: Ring, box: tuple[float, float, float, float], erase: bool = False) -> list[Ring]:
    """The parts of a line inside (or outside) of a box."""
    ins, outs = [], []
    cur_in: Ring = []
    cur_out: Ring = []
    for a, b in zip(line, line[1:]):
        t0, t1 = 0.0, 1.0
        for p, q in ((a[0] - b[0], a[0] - box[0]), (b[0] - a[0], box[2] - a[0]), (a[1] - b[1], a[1] - box[1]), (b[1] - a[1], box[3] - a[1])):
            if p == 0:
                if q < 0:
                    t0, t1 = 1.0, 0.0
                    break
            else:
                r = q / p
                t0, t1 = (max(t0, r), t1) if p < 0 else (t0, min(t1, r))
        if t0 >= t1:
            cur_out = cur_out or [a]
            cur_out.append(b)
            if cur_in:
                ins.append(cur_in)
                cur_in = []
            continue
        p, q = between(a, b, t0) if t0 > 0 else a, between(a, b, t1) if t1 < 1 else b
        if t0 > 0:
            cur_out = [*(cur_out or [a]), p]
        if cur_out:
            outs.append(cur_out)
            cur_out = []
        cur_in = cur_in or [p]
        cur_in.append(q)
        if t1 < 1:
            ins.append(cur_in)
            cur_in, cur_out = [], [q, b]
    ins += [cur_in] if cur_in else []
    outs += [cur_out] if cur_out else []
    return [x for x in (outs if erase else ins) if len(x) > 1]


# --- planar arrangement --------------------------------------------------------------------------------------------


def _snapped(points: np.ndarray, size: float | None = None) -> np.ndarray:
    """Coordinates rounded so that equal places have equal coordinates; ``size``: the largest one of the map."""
    size = size or (float(np.abs(points).max()) if len(points) else 1.0)
    digits = 12 - int(math.floor(math.log10(size or 1.0))) - 1
    return np.round(points, digits) + 0.0


#: Rounds after which cutting is taken for endless: an error, never an unfinished result.
ROUNDS = 1_000


def split_segments(a: np.ndarray, b: np.ndarray, size: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Segments cut wherever they meet one another; each undirected segment once. Points are snapped.

    Snapping moves cut segments a little, which may make new ones meet: cutting is repeated until none do.
    """
    size = size or (float(max(np.abs(a).max(), np.abs(b).max())) if len(a) else 1.0)
    a, b = _snapped(a, size), _snapped(b, size)
    for _ in range(ROUNDS):
        swap = (a[:, 0] > b[:, 0]) | ((a[:, 0] == b[:, 0]) & (a[:, 1] > b[:, 1]))
        a, b = np.where(swap[:, None], b, a), np.where(swap[:, None], a, b)
        seg = np.unique(np.hstack([a, b]), axis=0)
        seg = seg[(seg[:, :2] != seg[:, 2:]).any(axis=1)]
        a, b = seg[:, :2], seg[:, 2:]
        cuts: dict[int, list[np.ndarray]] = defaultdict(list)
        for i, j in _overlapping(a, b):
            for k, p in _meetings(a, b, i, j, size):
                cuts[k].append(p)
        if not cuts:
            return a, b
        na, nb = [], []
        for k, ps in cuts.items():
            d = b[k] - a[k]
            q = _snapped(np.array(ps), size)
            order = np.argsort((q - a[k]) @ d)
            chain = np.vstack([a[k], q[order], b[k]])
            na.append(chain[:-1])
            nb.append(chain[1:])
        rest = np.setdiff1d(np.arange(len(a)), list(cuts))
        a, b = np.vstack([a[rest], *na]), np.vstack([b[rest], *nb])
    raise ValueError(f"segments still cross after {ROUNDS} rounds of cutting")


def _overlapping(a: np.ndarray, b: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of segments whose boxes meet, in blocks: sorted by x, each against those that begin within its span."""
    low, high = np.minimum(a[:, 1], b[:, 1]), np.maximum(a[:, 1], b[:, 1])
    order = np.argsort(a[:, 0], kind="stable")
    x0, x1 = a[order, 0], b[order, 0]
    end = np.searchsorted(x0, x1, side="right")
    out = []
    n = len(order)
    begin = 0
    while begin < n:
        stop, count = begin, 0
        while stop < n and (count == 0 or count < 400_000):
            count += end[stop] - stop - 1
            stop += 1
        sizes = np.maximum(end[begin:stop] - np.arange(begin, stop) - 1, 0)
        i = np.repeat(np.arange(begin, stop), sizes)
        j = i + 1 + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        i, j = order[i], order[j]
        meet = (low[i] <= high[j]) & (low[j] <= high[i])
        out.append((i[meet], j[meet]))
        begin = stop
    return out


def _meetings(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, size: float) -> list[tuple[int, np.ndarray]]:
    """(segment, point) where a segment must be cut: at crossings, and at ends of others that lie on it."""
    if not len(i):
        return []
    out = []
    p, r, q, s = a[i], b[i] - a[i], a[j], b[j] - a[j]
    cross = r[:, 0] * s[:, 1] - r[:, 1] * s[:, 0]
    scale = np.abs(r).sum(axis=1) * np.abs(s).sum(axis=1)
    par = np.abs(cross) <= 1e-14 * scale
    d = q - p
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (d[:, 0] * s[:, 1] - d[:, 1] * s[:, 0]) / cross
        u = (d[:, 0] * r[:, 1] - d[:, 1] * r[:, 0]) / cross
    eps = 1e-12
    ok = ~par & (t >= -eps) & (t <= 1 + eps) & (u >= -eps) & (u <= 1 + eps)
    if ok.any():
        at = _snapped(p[ok] + t[ok, None] * r[ok], size)
        for k, l, x, tt, uu in zip(i[ok], j[ok], at, t[ok], u[ok]):
            if tt <= eps or tt >= 1 - eps:
                x = a[k] if tt <= eps else b[k]
            elif uu <= eps or uu >= 1 - eps:
                x = a[l] if uu <= eps else b[l]
            if (x != a[k]).any() and (x != b[k]).any():
                out.append((int(k), x))
            if (x != a[l]).any() and (x != b[l]).any():
                out.append((int(l), x))
    for k, l in zip(i[par], j[par]):  # along one line: ends within the other
        for m, o in ((k, l), (l, k)):
            dm = b[m] - a[m]
            square = float(dm @ dm)
            for x in (a[o], b[o]):
                w = x - a[m]
                f = float(w @ dm) / square
                if 0 < f < 1 and abs(dm[0] * w[1] - dm[1] * w[0]) <= 1e-11 * square and (x != a[m]).any() and (x != b[m]).any():
                    out.append((int(m), x))
    return out


def faces(a: np.ndarray, b: np.ndarray) -> list[list[Ring]]:
    """The bounded faces of a planar graph given by its (already split) edges: outer ring, then holes."""
    points, inverse = np.unique(np.vstack([a, b]), axis=0, return_inverse=True)
    inverse = inverse.ravel()
    n = len(a)
    src, dst = np.concatenate([inverse[:n], inverse[n:]]), np.concatenate([inverse[n:], inverse[:n]])
    angle = np.arctan2(points[dst, 1] - points[src, 1], points[dst, 0] - points[src, 0])
    order = np.lexsort((angle, src))
    place = np.empty(2 * n, dtype=np.int64)
    place[order] = np.arange(2 * n)
    first = np.searchsorted(src[order], np.arange(len(points)))
    size = np.bincount(src, minlength=len(points))
    twin = np.concatenate([np.arange(n, 2 * n), np.arange(n)])
    # the next edge around a face on the left: at the end point, the one just clockwise of the way back
    back = place[twin]
    at = dst
    following = order[first[at] + (back - first[at] - 1) % size[at]]
    seen = np.zeros(2 * n, dtype=bool)
    outer, inner = [], []
    for e in range(2 * n):
        if seen[e]:
            continue
        walk = []
        while not seen[e]:
            seen[e] = True
            walk.append(src[e])
            e = following[e]
        ring = points[[*walk, walk[0]]].tolist()
        area = ring_area(ring)  # faces on the left are counter-clockwise, so negative here
        if area < 0:
            outer.append(ring[::-1])
        elif area > 0:
            inner.append(ring[::-1])
    out = [[r] for r in outer]
    if inner:
        areas = [ring_area(r) for r in outer]
        boxes = np.array([(*np.min(r, axis=0), *np.max(r, axis=0)) for r in outer]).reshape(-1, 4)
        for h in inner:
            hb = (*np.min(h, axis=0), *np.max(h, axis=0))
            around = np.flatnonzero((boxes[:, 0] <= hb[0]) & (boxes[:, 1] <= hb[1]) & (boxes[:, 2] >= hb[2]) & (boxes[:, 3] >= hb[3]))
            best = None
            for i in around:
                if areas[i] > abs(ring_area(h)) and (best is None or areas[i] < areas[best]):
                    free = next((p for p in h if tuple(p) not in {tuple(q) for q in outer[i]}), None)
                    if free is not None and in_ring(free[0], free[1], outer[i]):
                        best = i
            if best is not None:
                out[best].append(h)
    return out


def mosaic(shapes: list[list[Ring]], size: float | None = None) -> list[tuple[list[Ring], list[int]]]:
    """Tiles of overlapping polygons: (rings, numbers of the polygons that cover the tile); gaps have none."""
    a, b = [], []
    for rings in shapes:
        for r in rings:
            r = closed(r)
            if len(r) > 3:
                xy = np.asarray(r, dtype=float)[:, :2]
                a.append(xy[:-1])
                b.append(xy[1:])
    if not a:
        return []
    sa, sb = split_segments(np.vstack(a), np.vstack(b), size)
    tiles = faces(sa, sb)
    spots = [face_point(t) for t in tiles]
    index = Regions((i, [rings]) for i, rings in enumerate(shapes))
    at, region = index.containing(np.array([s[0] for s in spots]), np.array([s[1] for s in spots]))
    held: dict[int, list[int]] = defaultdict(list)
    for t, i in zip(at.tolist(), region.tolist()):
        held[t].append(int(i))
    return [(t, sorted(held[k])) for k, t in enumerate(tiles)]


def face_point(tile: list[Ring]) -> tuple[float, float]:
    """A point inside of a face: in the middle of a stretch of a horizontal line that misses all vertices."""
    ys = sorted({p[1] for r in tile for p in r})
    best = (-1.0, tile[0][0][0], tile[0][0][1])
    gaps = sorted(zip(ys, ys[1:]), key=lambda g: g[0] - g[1])[:3]
    for low, high in gaps:
        y = (low + high) / 2
        xs = sorted(ax + (y - ay) * (bx - ax) / (by - ay) for r in tile for (ax, ay), (bx, by) in zip(r, r[1:]) if (ay > y) != (by > y))
        for p, q in zip(xs[::2], xs[1::2]):
            if q - p > best[0]:
                best = (q - p, (p + q) / 2, y)
    return best[1], best[2]


def merged(tiles: list[list[Ring]]) -> list[Ring]:
    """The rings around a set of tiles: edges that two tiles share cancel, what is left is chained into rings."""
    edges: dict[tuple, int] = defaultdict(int)
    for t in tiles:
        for r in t:
            for p, q in zip(r, r[1:]):
                edges[(tuple(p), tuple(q))] += 1
    left: dict[tuple, list[tuple]] = defaultdict(list)
    for (p, q), n in edges.items():
        for _ in range(n - edges.get((q, p), 0)):
            left[p].append(q)
    return chained(left)


def chained(left: dict[tuple, list[tuple]]) -> list[Ring]:
    """Directed edges as closed rings; at a point with several ways on, the sharpest right turn keeps rings apart."""
    out = []
    for start in list(left):
        while left.get(start):
            ring, p, q = [start], start, left[start].pop()
            while q != start:
                ring.append(q)
                ways = left.get(q) or []
                if not ways:
                    break
                if len(ways) > 1:
                    back = math.atan2(p[1] - q[1], p[0] - q[0])
                    ways.sort(key=lambda w: (back - math.atan2(w[1] - q[1], w[0] - q[0])) % (2 * math.pi) or 2 * math.pi)
                p, q = q, ways.pop()
            if q == start and len(ring) > 2:
                out.append([list(x) for x in [*ring, start]])
    return [r for r in out if ring_area(r)]


def cleaned(rings: list[Ring]) -> list[Ring]:
    """Rings without self-crossings that cover what the given ones do by even and odd."""
    return merged([t for t, held in mosaic([rings]) if held])


def clipped(subject: list[Ring], clips: list[list[Ring]], erase: bool = False) -> list[Ring]:
    """The part of a polygon inside (or outside) of any of the clipping polygons."""
    tiles = mosaic([subject, *clips])
    return merged([t for t, held in tiles if held and held[0] == 0 and (len(held) > 1) != erase])


def line_clipped(lines: list[Ring], clips: list[list[Ring]], erase: bool = False) -> list[Ring]:
    """The parts of lines inside (or outside) of any polygon: lines are cut at the edges, pieces tested by midpoint."""
    edges_a, edges_b = [], []
    for rings in clips:
        for r in rings:
            xy = np.asarray(closed(r), dtype=float)[:, :2]
            edges_a.append(xy[:-1])
            edges_b.append(xy[1:])
    ea = np.vstack(edges_a) if edges_a else np.zeros((0, 2))
    eb = np.vstack(edges_b) if edges_b else ea
    index = Regions((i, [rings]) for i, rings in enumerate(clips))
    out = []
    for line in lines:
        pieces: list[tuple[Point, Point]] = []
        for p, q in zip(line, line[1:]):
            p0, r = np.array(p[:2]), np.array(q[:2]) - np.array(p[:2])
            s, d = eb - ea, ea - p0
            cross = r[0] * s[:, 1] - r[1] * s[:, 0]
            with np.errstate(divide="ignore", invalid="ignore"):
                t, u = (d[:, 0] * s[:, 1] - d[:, 1] * s[:, 0]) / cross, (d[:, 0] * r[1] - d[:, 1] * r[0]) / cross
            cuts = sorted({0.0, 1.0, *t[(cross != 0) & (t > 0) & (t < 1) & (u >= 0) & (u <= 1)].tolist()})
            pieces += [(between(p, q, a) if a else list(p), between(p, q, b) if b < 1 else list(q)) for a, b in zip(cuts, cuts[1:])]
        if not pieces:
            continue
        mids = np.array([between(a, b, 0.5)[:2] for a, b in pieces])
        hit, _ = index.containing(mids[:, 0], mids[:, 1])
        inside = np.isin(np.arange(len(pieces)), hit)
        current: Ring = []
        for (a, b), i in zip(pieces, inside):
            if i != erase:
                if not current:
                    current = [a]
                current.append(b)
            elif current:
                out.append(current)
                current = []
        if current:
            out.append(current)
    return out


# --- Delaunay ------------------------------------------------------------------------------------------------------


def delaunay(points: list[Point]) -> list[tuple[int, int, int]]:
    """Triangles of distinct points (incremental insertion)."""
    p = np.asarray(points, dtype=float)
    n = len(p)
    if n < 3:
        return []
    low, high = p.min(axis=0), p.max(axis=0)
    mid, span = (low + high) / 2, float((high - low).max()) or 1.0
    pts = [*map(tuple, p.tolist()), (mid[0] - 3e3 * span, mid[1] - 2e3 * span), (mid[0] + 3e3 * span, mid[1] - 2e3 * span), (mid[0], mid[1] + 3e3 * span)]
    triangles: dict[tuple[int, int, int], tuple[float, float, float]] = {}

    def circle(t: tuple[int, int, int]) -> tuple[float, float, float]:
        (ax, ay), (bx, by), (cx, cy) = (pts[i] for i in t)
        bx, by, cx, cy = bx - ax, by - ay, cx - ax, cy - ay
        d = 2 * (bx * cy - by * cx)
        if d == 0:
            return (0.0, 0.0, math.inf)
        ux, uy = (cy * (bx * bx + by * by) - by * (cx * cx + cy * cy)) / d, (bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by)) / d
        return (ax + ux, ay + uy, ux * ux + uy * uy)

    first = (n, n + 1, n + 2)
    triangles[first] = circle(first)
    for i in np.lexsort((p[:, 1], p[:, 0])).tolist():
        x, y = pts[i]
        bad = [t for t, (cx, cy, r) in triangles.items() if (x - cx) ** 2 + (y - cy) ** 2 < r * (1 + 1e-12)]
        edges: dict[tuple[int, int], int] = defaultdict(int)
        for t in bad:
            for e in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])):
                edges[(min(e), max(e))] += 1
            del triangles[t]
        for (u, v), k in edges.items():
            if k == 1:
                t = (u, v, i)
                triangles[t] = circle(t)
    return [t for t in triangles if max(t) < n]
