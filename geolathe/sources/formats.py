"""Binary and XML formats in plain Python: bytes to features (layer, type, parts, properties) and back.

Parts follow the layers' convention: points are [x, y], lines and rings lists of points, outer rings clockwise.
"""

from __future__ import annotations

import datetime
import json
import sqlite3
import struct
import xml.etree.ElementTree as ET
from collections import defaultdict
from collections.abc import Iterable, Iterator

from geolathe.functions.shapes import closed, in_ring, nested, ring_area

Feature = tuple[str, str | None, list | None, dict]


def wound(ring: list, outer: bool) -> list:
    """The ring turning clockwise (outer) or the other way (hole)."""
    a = ring_area(ring)
    return ring[::-1] if (a < 0) == outer and a else ring


def polygon_parts(polygons: list) -> list:
    """Polygons (lists of rings, the outer one first) as parts."""
    return [wound(closed([list(map(float, p[:2])) for p in r]), i == 0) for poly in polygons for i, r in enumerate(poly or []) if r]


def line_parts(lines: list) -> list:
    return [[list(map(float, p[:2])) for p in x] for x in lines if x]


# --- GeoJSON -------------------------------------------------------------------------------------------------------


def from_geojson(g: dict | None) -> dict[str, list]:
    """Parts by layer type of a GeoJSON geometry; collections are taken apart."""
    out: dict[str, list] = {}
    if not g:
        return out
    c = g.get("coordinates")
    t = g.get("type")
    if t == "GeometryCollection":
        for sub in g.get("geometries") or []:
            for k, v in from_geojson(sub).items():
                out.setdefault(k, []).extend(v)
        return out
    if not c:
        return out
    if t in ("Point", "MultiPoint"):
        out["point"] = [list(map(float, p[:2])) for p in ([c] if t == "Point" else c)]
    elif t in ("LineString", "MultiLineString"):
        out["polyline"] = line_parts([c] if t == "LineString" else c)
    elif t in ("Polygon", "MultiPolygon"):
        out["polygon"] = polygon_parts([c] if t == "Polygon" else c)
    return out


def to_geojson(kind: str | None, parts: list | None, rfc7946: bool = False) -> dict | None:
    """A GeoJSON geometry; with ``rfc7946`` outer rings turn counter-clockwise."""
    if not parts or not kind:
        return None
    if kind == "point":
        return {"type": "Point", "coordinates": parts[0]} if len(parts) == 1 else {"type": "MultiPoint", "coordinates": parts}
    if kind == "polyline":
        return {"type": "LineString", "coordinates": parts[0]} if len(parts) == 1 else {"type": "MultiLineString", "coordinates": parts}
    groups = nested(parts)
    if rfc7946:
        groups = [[r[::-1] for r in g] for g in groups]
    if not groups:
        return None
    return {"type": "Polygon", "coordinates": groups[0]} if len(groups) == 1 else {"type": "MultiPolygon", "coordinates": groups}


# --- WKB -----------------------------------------------------------------------------------------------------------


def from_wkb(data: bytes) -> dict[str, list]:
    """Parts by layer type of a WKB geometry (ISO or extended, any byte order; more dimensions are dropped)."""
    out: dict[str, list] = {}

    def read(at: int) -> int:
        order = "<" if data[at] == 1 else ">"
        code = struct.unpack_from(order + "I", data, at + 1)[0]
        at += 5
        dims = 2
        if code & 0x20000000:
            at += 4
        dims += bool(code & 0x80000000) + bool(code & 0x40000000)
        code &= 0xFFFF
        dims += {0: 0, 1: 1, 2: 1, 3: 2}[code // 1000]
        code %= 1000

        def point(a: int) -> tuple[list, int]:
            return list(struct.unpack_from(order + "2d", data, a)), a + 8 * dims

        def points(a: int) -> tuple[list, int]:
            n = struct.unpack_from(order + "I", data, a)[0]
            a += 4
            got = []
            for _ in range(n):
                p, a = point(a)
                got.append(p)
            return got, a

        if code == 1:
            p, at = point(at)
            if p[0] == p[0]:
                out.setdefault("point", []).append(p)
        elif code == 2:
            line, at = points(at)
            if line:
                out.setdefault("polyline", []).append(line)
        elif code == 3:
            n = struct.unpack_from(order + "I", data, at)[0]
            at += 4
            rings = []
            for _ in range(n):
                r, at = points(at)
                rings.append(r)
            out.setdefault("polygon", []).extend(polygon_parts([rings]))
        else:
            n = struct.unpack_from(order + "I", data, at)[0]
            at += 4
            for _ in range(n):
                at = read(at)
        return at

    read(0)
    return out


def to_wkb(kind: str, parts: list) -> bytes:
    pts = lambda r: struct.pack("<I", len(r)) + b"".join(struct.pack("<2d", *p[:2]) for p in r)
    one = {
        "point": [struct.pack("<BI2d", 1, 1, *p[:2]) for p in parts] if kind == "point" else [],
        "polyline": [struct.pack("<BI", 1, 2) + pts(r) for r in parts] if kind == "polyline" else [],
        "polygon": [struct.pack("<BII", 1, 3, len(g)) + b"".join(pts(r) for r in g) for g in nested(parts)] if kind == "polygon" else [],
    }[kind]
    if len(one) == 1:
        return one[0]
    return struct.pack("<BII", 1, {"point": 4, "polyline": 5, "polygon": 6}[kind], len(one)) + b"".join(one)


# --- Shapefile and DBF ---------------------------------------------------------------------------------------------

SHAPE_TYPES = {1: "point", 11: "point", 21: "point", 8: "point", 18: "point", 28: "point", 3: "polyline", 13: "polyline", 23: "polyline", 5: "polygon", 15: "polygon", 25: "polygon"}


def read_shp(data: bytes) -> tuple[str | None, list[list | None]]:
    """The layer type and the parts of each record."""
    kind = SHAPE_TYPES.get(struct.unpack_from("<i", data, 32)[0])
    at, out = 100, []
    while at + 12 <= len(data):
        size = struct.unpack_from(">i", data, at + 4)[0] * 2
        body = at + 8
        code = struct.unpack_from("<i", data, body)[0]
        if code in (1, 11, 21):
            out.append([list(struct.unpack_from("<2d", data, body + 4))])
        elif code in (8, 18, 28):
            n = struct.unpack_from("<i", data, body + 36)[0]
            v = struct.unpack_from(f"<{2 * n}d", data, body + 40)
            out.append([list(v[i : i + 2]) for i in range(0, 2 * n, 2)])
        elif code in SHAPE_TYPES:
            m, n = struct.unpack_from("<2i", data, body + 36)
            starts = [*struct.unpack_from(f"<{m}i", data, body + 44), n]
            v = struct.unpack_from(f"<{2 * n}d", data, body + 44 + 4 * m)
            out.append([[list(v[2 * i : 2 * i + 2]) for i in range(a, b)] for a, b in zip(starts, starts[1:])])
        else:
            out.append(None)
        at = body + size
    return kind, out


def read_dbf(data: bytes, encoding: str = "utf-8") -> list[dict]:
    """Records: N and F as numbers, I as 32-bit integers, L as booleans, D as dates, C as text; blank is null."""
    n, head, size = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode("latin-1"), chr(data[at + 11]), data[at + 16], data[at + 17]))
        at += 32
    out = []
    for i in range(n):
        at = head + i * size + 1
        row: dict = {}
        for name, kind, width, _ in fields:
            raw = data[at : at + width]
            at += width
            text = raw.decode(encoding, "replace").strip(" \0")
            if kind == "I":
                row[name] = struct.unpack("<i", raw)[0]
            elif not text:
                row[name] = None if kind != "C" else ""
            elif kind in "NF":
                try:
                    row[name] = float(text) if any(c in text for c in ".eE") else int(text)
                except ValueError:
                    row[name] = None
            elif kind == "L":
                row[name] = {"T": True, "t": True, "Y": True, "y": True, "F": False, "f": False, "N": False, "n": False}.get(text)
            elif kind == "D":
                row[name] = f"{text[:4]}-{text[4:6]}-{text[6:8]}" if len(text) == 8 else None
            else:
                row[name] = text
        out.append(row)
    return out


def write_dbf(rows: list[dict], names: list[str]) -> bytes:
    """Numbers as N, booleans as L, all else as C; names are cut to ten bytes and made unique."""
    specs, used = [], set()
    for f in names:
        vals = [r.get(f) for r in rows if r.get(f) is not None]
        short = f[:10]
        k = 1
        while short in used:
            short, k = f[: 9 - len(str(k))] + f"_{k}", k + 1
        used.add(short)
        if vals and all(isinstance(v, bool) for v in vals):
            specs.append((f, short, "L", 1, 0))
        elif vals and all(isinstance(v, (int, float)) for v in vals):
            places = max((len(repr(float(v)).split(".")[1]) if isinstance(v, float) and v != int(v) and "e" not in repr(v) else 0) for v in vals)
            places = min(places, 15)
            specs.append((f, short, "N", min(19 + (places > 0), max(len(f"{v:.{places}f}") for v in vals)), places))
        else:
            specs.append((f, short, "C", max([1, *(min(254, len(str(v).encode())) for v in vals)]), 0))
    size = 1 + sum(s[3] for s in specs)
    head = struct.pack("<BBBBIHH20x", 3, 95, 7, 26, len(rows), 33 + 32 * len(specs), size)
    for _, short, kind, width, places in specs:
        head += struct.pack("<11sc4xBB14x", short.encode("latin-1", "replace"), kind.encode(), width, places)
    body = bytearray()
    for r in rows:
        body += b" "
        for f, _, kind, width, places in specs:
            v = r.get(f)
            text = "" if v is None else ("T" if v else "F") if kind == "L" else f"{v:.{places}f}" if kind == "N" else str(v)
            raw = text.encode()[:width]
            body += raw.rjust(width) if kind == "N" else raw.ljust(width)
    return head + b"\r" + bytes(body) + b"\x1a"


def write_shp(kind: str, shapes: list[list | None]) -> tuple[bytes, bytes]:
    """.shp and .shx."""
    code = {"point": 1, "polyline": 3, "polygon": 5}[kind]
    multi = kind == "point" and any(s and len(s) > 1 for s in shapes)
    code = 8 if multi else code
    records, index, at = b"", b"", 50
    box = [float("inf"), float("inf"), float("-inf"), float("-inf")]
    for i, s in enumerate(shapes):
        if not s:
            body = struct.pack("<i", 0)
        else:
            flat = s if kind == "point" else [p for r in s for p in r]
            xs, ys = [p[0] for p in flat], [p[1] for p in flat]
            own = (min(xs), min(ys), max(xs), max(ys))
            box = [min(box[0], own[0]), min(box[1], own[1]), max(box[2], own[2]), max(box[3], own[3])]
            coords = b"".join(struct.pack("<2d", p[0], p[1]) for p in flat)
            if code == 1:
                body = struct.pack("<i", 1) + coords
            elif code == 8:
                body = struct.pack("<i4di", 8, *own, len(flat)) + coords
            else:
                starts, n = [], 0
                for r in s:
                    starts.append(n)
                    n += len(r)
                body = struct.pack("<i4d2i", code, *own, len(s), n) + struct.pack(f"<{len(s)}i", *starts) + coords
        records += struct.pack(">2i", i + 1, len(body) // 2) + body
        index += struct.pack(">2i", at, len(body) // 2)
        at += 4 + len(body) // 2
    box = box if box[0] <= box[2] else [0.0] * 4
    head = lambda size: struct.pack(">i20xi", 9994, size // 2) + struct.pack("<2i4d32x", 1000, code, *box)
    return head(100 + len(records)) + records, head(100 + len(index)) + index


# --- TopoJSON ------------------------------------------------------------------------------------------------------


def read_topojson(text: str) -> Iterator[Feature]:
    topo = json.loads(text)
    t = topo.get("transform")
    sx, sy, tx, ty = (*t["scale"], *t["translate"]) if t else (1.0, 1.0, 0.0, 0.0)
    arcs = []
    for arc in topo.get("arcs", []):
        x = y = 0.0
        out = []
        for p in arc:
            x, y = (x + p[0], y + p[1]) if t else (p[0], p[1])
            out.append([x * sx + tx, y * sy + ty])
        arcs.append(out)

    def path(ids: list[int]) -> list:
        out: list = []
        for i in ids:
            a = arcs[i] if i >= 0 else arcs[~i][::-1]
            out += a if not out else a[1:]
        return out

    place = lambda p: [p[0] * sx + tx, p[1] * sy + ty]

    def parts(g: dict) -> tuple[str | None, list | None]:
        k = g.get("type")
        if k == "Point":
            return "point", [place(g["coordinates"])]
        if k == "MultiPoint":
            return "point", [place(p) for p in g["coordinates"]]
        if k in ("LineString", "MultiLineString"):
            return "polyline", [path(a) for a in ([g["arcs"]] if k == "LineString" else g["arcs"])]
        if k in ("Polygon", "MultiPolygon"):
            return "polygon", polygon_parts([[path(r) for r in poly] for poly in ([g["arcs"]] if k == "Polygon" else g["arcs"])])
        return None, None

    for name, o in topo.get("objects", {}).items():
        for g in o["geometries"] if o.get("type") == "GeometryCollection" else [o]:
            kind, p = parts(g)
            props = dict(g.get("properties") or {})
            yield name, kind, p, props


def write_topojson(layers: dict[str, tuple[str, list[tuple[list | None, dict]]]], quantization: int | None = None) -> str:
    """Layers as one topology: rings and lines are cut where other arcs meet them, and common arcs stored once."""
    links: dict[tuple, set] = defaultdict(set)
    for kind, feats in layers.values():
        for parts, _ in feats if kind != "point" else []:
            for r in parts or []:
                for p, q in zip(r, r[1:]):
                    links[tuple(p)].add(tuple(q))
                    links[tuple(q)].add(tuple(p))
    from geolathe.functions.shapes import split_at

    arcs: list[list] = []
    known: dict[tuple, int] = {}

    def ids(part: list) -> list[int]:
        out = []
        for arc in split_at(part, [len(links[tuple(p)]) != 2 for p in part]):
            key = tuple(map(tuple, arc))
            if key in known:
                out.append(known[key])
            elif key[::-1] in known:
                out.append(~known[key[::-1]])
            else:
                known[key] = len(arcs)
                out.append(len(arcs))
                arcs.append([list(p) for p in arc])
        return out

    objects = {}
    for name, (kind, feats) in layers.items():
        geoms = []
        for parts, props in feats:
            g: dict = {"type": None}
            if parts and kind == "point":
                g = {"type": "Point", "coordinates": parts[0]} if len(parts) == 1 else {"type": "MultiPoint", "coordinates": parts}
            elif parts and kind == "polyline":
                a = [ids(p) for p in parts]
                g = {"type": "LineString", "arcs": a[0]} if len(a) == 1 else {"type": "MultiLineString", "arcs": a}
            elif parts:
                a2 = [[ids(r) for r in poly] for poly in nested(parts)]
                g = {"type": "Polygon", "arcs": a2[0]} if len(a2) == 1 else {"type": "MultiPolygon", "arcs": a2}
            geoms.append({**g, "properties": props} if props else g)
        objects[name] = {"type": "GeometryCollection", "geometries": geoms}
    topo: dict = {"type": "Topology", "arcs": arcs, "objects": objects}
    if quantization and arcs:
        xs, ys = [p[0] for a in arcs for p in a], [p[1] for a in arcs for p in a]
        sx, sy = (max(xs) - min(xs)) / (quantization - 1) or 1.0, (max(ys) - min(ys)) / (quantization - 1) or 1.0
        topo["transform"] = {"scale": [sx, sy], "translate": [min(xs), min(ys)]}
        topo["arcs"] = []
        for a in arcs:
            q = [(round((p[0] - min(xs)) / sx), round((p[1] - min(ys)) / sy)) for p in a]
            topo["arcs"].append([list(q[0]), *[[b[0] - c[0], b[1] - c[1]] for c, b in zip(q, q[1:])]])
    return json.dumps(topo, ensure_ascii=False)


# --- KML -----------------------------------------------------------------------------------------------------------


def read_kml(text: str) -> Iterator[Feature]:
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    coords = lambda e: [[float(v) for v in c.split(",")[:2]] for c in (e.text or "").split()]
    for pm in ET.fromstring(text).iter():
        if local(pm) != "Placemark":
            continue
        props: dict = {}
        found: dict[str, list] = defaultdict(list)
        for e in pm.iter():
            n = local(e)
            if n in ("name", "description") and e.text is not None:
                props[n] = e.text
            elif n == "Data":
                props[e.get("name", "")] = next((v.text for v in e if local(v) == "value"), None)
            elif n == "SimpleData":
                props[e.get("name", "")] = e.text
            elif n == "Point":
                found["point"] += [c for x in e.iter() if local(x) == "coordinates" for c in coords(x)]
            elif n == "LineString":
                found["polyline"] += [coords(x) for x in e.iter() if local(x) == "coordinates"]
            elif n == "Polygon":
                outer = [coords(x) for o in e if local(o) == "outerBoundaryIs" for x in o.iter() if local(x) == "coordinates"]
                inner = [coords(x) for o in e if local(o) == "innerBoundaryIs" for x in o.iter() if local(x) == "coordinates"]
                found["polygon"] += polygon_parts([[*outer, *inner]])
        for kind, parts in found.items() if found else [(None, None)]:
            yield "kml", kind, parts, props


def write_kml(name: str, kind: str, feats: Iterable[tuple[list | None, dict]]) -> str:
    root = ET.Element("kml", xmlns="http://www.opengis.net/kml/2.2")
    doc = ET.SubElement(root, "Document", id=name)
    text = lambda r: " ".join(f"{p[0]},{p[1]}" for p in r)
    for parts, props in feats:
        pm = ET.SubElement(doc, "Placemark")
        if props.get("name") is not None:
            ET.SubElement(pm, "name").text = str(props["name"])
        data = ET.SubElement(pm, "ExtendedData")
        for k, v in props.items():
            ET.SubElement(ET.SubElement(data, "Data", name=k), "value").text = "" if v is None else str(v)
        home = ET.SubElement(pm, "MultiGeometry") if parts and len(parts) > 1 else pm
        if kind == "polygon":
            for g in nested(parts or []):
                poly = ET.SubElement(home, "Polygon")
                for i, r in enumerate(g):
                    side = ET.SubElement(poly, "innerBoundaryIs" if i else "outerBoundaryIs")
                    ET.SubElement(ET.SubElement(side, "LinearRing"), "coordinates").text = text(r)
        else:
            for p in parts or []:
                ET.SubElement(ET.SubElement(home, "Point" if kind == "point" else "LineString"), "coordinates").text = text([p] if kind == "point" else p)
    return ET.tostring(root, encoding="unicode")


# --- GeoPackage ----------------------------------------------------------------------------------------------------


def read_gpkg(data: bytes, layers: list[str] | None = None) -> Iterator[Feature]:
    con = sqlite3.connect(":memory:")
    con.deserialize(data)
    con.row_factory = sqlite3.Row
    geometry = {r[0]: r[1] for r in con.execute("SELECT table_name, column_name FROM gpkg_geometry_columns")}
    for name, column in geometry.items():
        if layers and name not in layers:
            continue
        for r in con.execute(f'SELECT * FROM "{name}"'):
            props = {k: r[k] for k in r.keys() if k not in (column, "fid")}
            blob = r[column]
            if not blob:
                yield name, None, None, props
                continue
            skip = 8 + {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[(blob[3] >> 1) & 7]
            got = from_wkb(blob[skip:])
            for kind, parts in got.items() if got else [(None, None)]:
                yield name, kind, parts, props


def write_gpkg(name: str, kind: str, feats: Iterable[tuple[list | None, dict]], names: list[str]) -> bytes:
    con = sqlite3.connect(":memory:")
    con.executescript(
        "CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT, srs_id INTEGER PRIMARY KEY, organization TEXT, organization_coordsys_id INTEGER, definition TEXT, description TEXT);"
        "CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT, identifier TEXT, description TEXT, last_change TEXT, min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER);"
        "CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER, z INTEGER, m INTEGER);"
        "INSERT INTO gpkg_spatial_ref_sys VALUES ('WGS 84', 4326, 'EPSG', 4326, 'GEOGCS', NULL);"
    )
    feats = list(feats)
    kinds = {}
    for f in names:
        vals = [p.get(f) for _, p in feats if p.get(f) is not None]
        kinds[f] = "BOOLEAN" if vals and all(isinstance(v, bool) for v in vals) else "INTEGER" if vals and all(isinstance(v, int) for v in vals) else "DOUBLE" if vals and all(isinstance(v, (int, float)) for v in vals) else "TEXT"
    quoted = ", ".join(f'"{f}" {k}' for f, k in kinds.items())
    con.execute(f'CREATE TABLE "{name}" (fid INTEGER PRIMARY KEY, geom BLOB{", " + quoted if quoted else ""})')
    con.execute("INSERT INTO gpkg_contents VALUES (?, 'features', ?, '', datetime('now'), NULL, NULL, NULL, NULL, 4326)", (name, name))
    con.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 'GEOMETRY', 4326, 0, 0)", (name,))
    for parts, props in feats:
        blob = b"GP\0\1" + struct.pack("<i", 4326) + to_wkb(kind, parts) if parts else None
        vals = [json.dumps(v) if isinstance(v, (list, dict)) else v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v for v in (props.get(f) for f in names)]
        con.execute(f'INSERT INTO "{name}" VALUES ({", ".join("?" * (len(names) + 2))})', (None, blob, *vals))
    con.commit()
    return con.serialize()


def shp_parts(kind: str | None, parts: list | None) -> list | None:
    """Parts as read from a shapefile, with the winding that layers have."""
    if not parts or kind != "polygon":
        return parts
    rings = [closed(r) for r in parts]
    outer = [r for r in rings if ring_area(r) > 0]
    if outer or not rings:
        return rings
    # all rings turn the wrong way: those within another one are holes
    return [wound(r, not any(q is not r and in_ring(*r[0], q) for q in rings)) for r in rings]
