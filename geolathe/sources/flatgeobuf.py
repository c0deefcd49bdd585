"""FlatGeobuf: a header and a row of features as FlatBuffers tables, read and written without a library.

A FlatBuffers table begins with the distance back to its vtable, which says where each of its fields lies; strings,
vectors and tables within a field are pointed to by a distance forward.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterable, Iterator

from geolathe.sources.formats import Feature, from_geojson, to_geojson

# The first bytes, the names of geometry types by number, and the columns' types by number.
MAGIC = b"fgb\x03fgb\x00"
TYPES = ["Unknown", "Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon", "GeometryCollection"]
SCALARS = {0: "b", 1: "B", 2: "?", 3: "h", 4: "H", 5: "i", 6: "I", 7: "q", 8: "Q", 9: "f", 10: "d"}
BOOL, LONG, DOUBLE, STRING, JSON, BINARY = 2, 7, 10, 11, 12, 14


class Table:
    """A table at a place in a buffer; fields are numbered."""

    def __init__(self, data: bytes, at: int) -> None:
        self.data, self.at = data, at
        self.vtable = at - struct.unpack_from("<i", data, at)[0]
        self.size = struct.unpack_from("<H", data, self.vtable)[0]

    def place(self, field: int) -> int:
        """Where a field lies, 0 if it's absent."""
        slot = 4 + 2 * field
        offset = struct.unpack_from("<H", self.data, self.vtable + slot)[0] if slot < self.size else 0
        return self.at + offset if offset else 0

    def scalar(self, field: int, form: str, default: int = 0) -> int:
        at = self.place(field)
        return struct.unpack_from("<" + form, self.data, at)[0] if at else default

    def target(self, field: int) -> int:
        at = self.place(field)
        return at + struct.unpack_from("<I", self.data, at)[0] if at else 0

    def vector(self, field: int, form: str) -> tuple:
        at = self.target(field)
        n = struct.unpack_from("<I", self.data, at)[0] if at else 0
        return struct.unpack_from(f"<{n}{form}", self.data, at + 4) if n else ()

    def raw(self, field: int) -> bytes:
        at = self.target(field)
        return self.data[at + 4 : at + 4 + struct.unpack_from("<I", self.data, at)[0]] if at else b""

    def table(self, field: int) -> Table | None:
        at = self.target(field)
        return Table(self.data, at) if at else None

    def tables(self, field: int) -> list[Table]:
        at = self.target(field)
        n = struct.unpack_from("<I", self.data, at)[0] if at else 0
        return [Table(self.data, p + struct.unpack_from("<I", self.data, p)[0]) for p in range(at + 4, at + 4 + 4 * n, 4)]


def _root(data: bytes, at: int) -> Table:
    return Table(data, at + struct.unpack_from("<I", data, at)[0])


def _geojson(g: Table, kind: int) -> dict:
    kind = g.scalar(6, "B") or kind
    name = TYPES[kind]
    if name in ("MultiPolygon", "GeometryCollection"):
        parts = [_geojson(p, 3 if name == "MultiPolygon" else 0) for p in g.tables(7)]
        return {"type": name, "coordinates": [p["coordinates"] for p in parts]} if name == "MultiPolygon" else {"type": name, "geometries": parts}
    xy = g.vector(1, "d")
    points = [[x, y] for x, y in zip(xy[::2], xy[1::2])]
    if name == "Point":
        return {"type": name, "coordinates": points[0] if points else []}
    if name in ("LineString", "MultiPoint"):
        return {"type": name, "coordinates": points}
    ends = g.vector(0, "I") or (len(points),)
    return {"type": name, "coordinates": [points[a:b] for a, b in zip((0, *ends), ends)]}


def _properties(data: bytes, columns: list[tuple[str, int]]) -> dict:
    out: dict = {name: None for name, _ in columns}
    at = 0
    while at < len(data):
        name, kind = columns[struct.unpack_from("<H", data, at)[0]]
        at += 2
        if kind in SCALARS:
            out[name] = struct.unpack_from("<" + SCALARS[kind], data, at)[0]
            at += struct.calcsize(SCALARS[kind])
        else:
            n = struct.unpack_from("<I", data, at)[0]
            text = data[at + 4 : at + 4 + n]
            out[name] = text.hex() if kind == BINARY else json.loads(text) if kind == JSON else text.decode("utf-8")
            at += 4 + n
    return out


def read(data: bytes, name: str) -> Iterator[Feature]:
    """The features of a file, with or without a spatial index."""
    if data[:4] != MAGIC[:4]:
        raise ValueError("not a FlatGeobuf file")
    size = struct.unpack_from("<I", data, 8)[0]
    head = _root(data, 12)
    columns = [(c.raw(0).decode("utf-8"), c.scalar(1, "B")) for c in head.tables(7)]
    kind, count, node = head.scalar(2, "B"), head.scalar(8, "Q"), head.scalar(9, "H", 16)
    at = 12 + size
    if node and count:
        nodes = level = count
        while level > 1 or nodes == count:
            level = -(-level // node)
            nodes += level
        at += 40 * nodes
    while at < len(data):
        size = struct.unpack_from("<I", data, at)[0]
        f = _root(data, at + 4)
        g = f.table(0)
        own = [(c.raw(0).decode("utf-8"), c.scalar(1, "B")) for c in f.tables(2)] or columns
        props = _properties(f.raw(1), own)
        parts = from_geojson(_geojson(g, kind)) if g else {}
        if not parts:
            yield name, None, None, props
        for k, v in parts.items():
            yield name, k, v, props
        at += 4 + size


class _Writer:
    """Tables written front to back: what a table points to follows it."""

    def __init__(self) -> None:
        self.buf = bytearray(4)

    def finished(self, fields: dict) -> bytes:
        """The buffer with its size before it, ``fields`` being those of the root table."""
        struct.pack_into("<I", self.buf, 0, self.table(fields))
        return struct.pack("<I", len(self.buf)) + bytes(self.buf)

    def table(self, fields: dict[int, tuple[str, object]]) -> int:
        """``fields``: number to (scalar form, value), or ("*", a function that writes what it points to)."""
        n = max(fields, default=-1) + 1
        offsets, at = {}, 4
        for k, (form, _) in sorted(fields.items(), key=lambda f: -struct.calcsize("I" if f[1][0] == "*" else f[1][0])):
            width = struct.calcsize("I" if form == "*" else form)
            at = -(-at // width) * width
            offsets[k] = at
            at += width
        while (len(self.buf) + 4 + 2 * n) % 8:
            self.buf.append(0)
        vtable, begin = len(self.buf), len(self.buf) + 4 + 2 * n
        self.buf += struct.pack(f"<{2 + n}H", 4 + 2 * n, at, *[offsets.get(k, 0) for k in range(n)]) + bytes(at)
        struct.pack_into("<i", self.buf, begin, begin - vtable)
        for k, (form, value) in fields.items():
            place = begin + offsets[k]
            if form == "*":
                struct.pack_into("<I", self.buf, place, value() - place)  # type: ignore[operator]
            else:
                struct.pack_into("<" + form, self.buf, place, value)
        return begin

    def vector(self, form: str, values: list) -> Callable[[], int]:
        def write() -> int:
            while (len(self.buf) + 4) % struct.calcsize(form) or len(self.buf) % 4:
                self.buf.append(0)
            at = len(self.buf)
            self.buf += struct.pack(f"<I{len(values)}{form}", len(values), *values)
            return at

        return write

    def raw(self, data: bytes, text: bool = False) -> Callable[[], int]:
        def write() -> int:
            while len(self.buf) % 4:
                self.buf.append(0)
            at = len(self.buf)
            self.buf.extend(struct.pack("<I", len(data)) + data + bytes(text))
            return at

        return write

    def tables(self, each: list[dict]) -> Callable[[], int]:
        def write() -> int:
            while len(self.buf) % 4:
                self.buf.append(0)
            at = len(self.buf)
            self.buf.extend(struct.pack("<I", len(each)) + bytes(4 * len(each)))
            for i, fields in enumerate(each):
                place = at + 4 + 4 * i
                struct.pack_into("<I", self.buf, place, self.table(fields) - place)
            return at

        return write

    def geometry(self, g: dict) -> dict:
        kind, c = g["type"], g.get("coordinates")
        fields: dict[int, tuple[str, object]] = {6: ("B", TYPES.index(kind))}
        if kind == "MultiPolygon":
            return fields | {7: ("*", self.tables([self.geometry({"type": "Polygon", "coordinates": p}) for p in c]))}
        lines = [[c]] if kind == "Point" else [c] if kind in ("LineString", "MultiPoint") else c
        if len(lines) > 1:
            ends, n = [], 0
            for line in lines:
                n += len(line)
                ends.append(n)
            fields[0] = ("*", self.vector("I", ends))
        return fields | {1: ("*", self.vector("d", [float(v) for line in lines for p in line for v in p[:2]]))}


def write(name: str, geo: str, rows: Iterable[tuple[list | None, dict]], fields: list[str]) -> bytes:
    """A file without a spatial index. Columns are booleans, whole numbers, numbers or texts by their values; nested
    values are JSON."""
    held = list(rows)
    kinds = {}
    for f in fields:
        values = [p[f] for _, p in held if p.get(f) is not None]
        kinds[f] = BOOL if values and all(isinstance(v, bool) for v in values) else LONG if values and all(isinstance(v, int) and not isinstance(v, bool) for v in values) else DOUBLE if values and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in values) else JSON if any(isinstance(v, (list, dict)) for v in values) else STRING
    head = _Writer()
    top = {0: ("*", head.raw(name.encode(), True)), 2: ("B", 0), 7: ("*", head.tables([{0: ("*", head.raw(f.encode(), True)), 1: ("B", kinds[f])} for f in fields])), 8: ("Q", len(held)), 9: ("H", 0)}
    out = [MAGIC, head.finished(top)]
    for parts, props in held:
        data = b""
        for i, f in enumerate(fields):
            v = props.get(f)
            if v is None:
                continue
            if kinds[f] in SCALARS:
                data += struct.pack("<H" + SCALARS[kinds[f]], i, v)
            else:
                text = (json.dumps(v, default=str) if kinds[f] == JSON else str(v)).encode("utf-8")
                data += struct.pack("<HI", i, len(text)) + text
        w = _Writer()
        own: dict[int, tuple[str, object]] = {1: ("*", w.raw(data))}
        g = to_geojson(geo, parts) if parts else None
        if g:
            shape = w.geometry(g)
            own[0] = ("*", lambda w=w, shape=shape: w.table(shape))
        out.append(w.finished(own))
    return b"".join(out)
