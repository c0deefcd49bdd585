"""Point-in-polygon tests over many points and polygons at once (numpy)."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

#: Edge tests done in one go; bounds the memory of a call.
CHUNK = 2_000_000


class Regions:
    """Polygons with holes, indexed by a grid of cells, for batches of points.

    ``shapes`` yields (region id, polygons), a polygon being a list of rings and a ring a list of [x, y]. A region
    contains a point if one of its polygons does; within a polygon the rings count by even and odd, so holes are
    outside. Points on an edge are inside. Rings may be open or closed and may repeat points; empty or null members
    are passed over.
    """

    def __init__(self, shapes: Iterable[tuple]) -> None:
        ids, starts, ends, counts, boxes = [], [], [], [], []
        for region, polygons in shapes:
            for polygon in polygons if polygons is not None else []:
                a, b = [], []
                for ring in polygon if polygon is not None else []:
                    points = [p for p in ring if p is not None] if ring is not None else []
                    xy = np.array([(p[0], p[1]) for p in points], dtype=float).reshape(-1, 2)
                    xy = xy[np.isfinite(xy).all(axis=1)]
                    if len(xy) >= 3:
                        a.append(xy)
                        b.append(np.roll(xy, -1, axis=0))
                if a:
                    pa, pb = np.concatenate(a), np.concatenate(b)
                    ids.append(region)
                    starts.append(pa)
                    ends.append(pb)
                    counts.append(len(pa))
                    boxes.append((*pa.min(axis=0), *pa.max(axis=0)))
        self.ids = np.array(ids, dtype=object if any(isinstance(i, str) for i in ids) else None)
        self.a = np.concatenate(starts) if starts else np.zeros((0, 2))
        self.b = np.concatenate(ends) if ends else np.zeros((0, 2))
        self.count = np.array(counts, dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)[:-1]]) if counts else self.count
        self.box = np.array(boxes, dtype=float).reshape(-1, 4)
        if counts:
            self._grid()

    def _grid(self) -> None:
        self.low, high = self.box[:, :2].min(axis=0), self.box[:, 2:].max(axis=0)
        self.n = max(1, min(1024, int(2 * np.sqrt(len(self.count)))))
        self.step = np.maximum((high - self.low) / self.n, 1e-300)
        cell = lambda xy: np.clip(((xy - self.low) / self.step).astype(np.int64), 0, self.n - 1)
        c0, c1 = cell(self.box[:, :2]), cell(self.box[:, 2:])
        spans = [(i, x * self.n + y) for i, ((x0, y0), (x1, y1)) in enumerate(zip(c0, c1)) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)]
        pairs = np.array(spans, dtype=np.int64)
        pairs = pairs[np.argsort(pairs[:, 1], kind="stable")]
        self.members = pairs[:, 0]
        self.offset = np.searchsorted(pairs[:, 1], np.arange(self.n * self.n + 1))

    def containing(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of points and the ids of the regions that contain them, as pairs without repeats."""
        none = np.zeros(0, dtype=np.int64)
        if not len(self.count) or not len(x):
            return none, self.ids[none] if len(self.ids) else none
        xy = np.column_stack([x, y])
        at = np.flatnonzero(np.isfinite(xy).all(axis=1) & (xy >= self.low).all(axis=1) & (xy <= self.low + self.step * self.n * (1 + 1e-12)).all(axis=1))
        c = np.clip(((xy[at] - self.low) / self.step).astype(np.int64), 0, self.n - 1)
        key = c[:, 0] * self.n + c[:, 1]
        n = self.offset[key + 1] - self.offset[key]
        point = np.repeat(at, n)
        polygon = self.members[np.repeat(self.offset[key] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
        box = self.box[polygon]
        px, py = x[point], y[point]
        fits = (px >= box[:, 0]) & (py >= box[:, 1]) & (px <= box[:, 2]) & (py <= box[:, 3])
        point, polygon = point[fits], polygon[fits]
        inside = np.zeros(len(point), dtype=bool)
        cuts = np.searchsorted(np.cumsum(self.count[polygon]), np.arange(CHUNK, self.count[polygon].sum() + CHUNK, CHUNK))
        begin = 0
        for cut in [*cuts, len(point)]:
            cut = min(len(point), max(cut, begin + 1))
            if begin < cut:
                inside[begin:cut] = self._test(x[point[begin:cut]], y[point[begin:cut]], polygon[begin:cut])
                begin = cut
        hit = np.unique(np.column_stack([point[inside], np.unique(self.ids, return_inverse=True)[1][polygon[inside]]]), axis=0)
        return hit[:, 0], np.unique(self.ids)[hit[:, 1]]

    def _test(self, x: np.ndarray, y: np.ndarray, polygon: np.ndarray) -> np.ndarray:
        n = self.count[polygon]
        head = np.concatenate([[0], np.cumsum(n)[:-1]])
        edge = np.repeat(self.first[polygon] - head, n) + np.arange(n.sum())
        (ax, ay), (bx, by) = self.a[edge].T, self.b[edge].T
        px, py = np.repeat(x, n), np.repeat(y, n)
        cross = (bx - ax) * (py - ay) - (px - ax) * (by - ay)
        up = by > ay
        crossing = ((ay > py) != (by > py)) & (np.where(up, cross, -cross) > 0)
        on = (cross == 0) & (px >= np.minimum(ax, bx)) & (px <= np.maximum(ax, bx)) & (py >= np.minimum(ay, by)) & (py <= np.maximum(ay, by))
        return (np.add.reduceat(crossing, head, dtype=np.int64) % 2 == 1) | np.logical_or.reduceat(on, head)
