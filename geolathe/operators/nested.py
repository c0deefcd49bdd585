"""Deeply nested GeoJSON packets as flat tables of features, line parts, WUI records and REV records.

One pass over the bodies emits linked rows (packet, feature_no, child, child_no, sub_no) and, where asked for, the
span of text each row stands for; the typed columns are then read from the short spans with built-in JSON functions.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolathe.functions.jsonspans import OPEN_A, OPEN_O, QUOTE, Spans

#: Bytes indexed at once; a longer body is indexed by itself.
CHUNK_BYTES = 4_000_000

Rows = list[tuple[np.ndarray, np.ndarray, str, np.ndarray, np.ndarray, list | None]]


def _wui(s: Spans, feature_of: np.ndarray, boxes: np.ndarray, spans: bool, kinds: set[str]) -> Rows:
    """WUI and REV rows of property objects: ``boxes`` are their containers, ``feature_of`` says whose they are."""
    out: Rows = []
    where = np.full(s.boxes + 1, -1, dtype=np.int64)
    where[boxes] = np.arange(len(boxes))

    def objects(parents: np.ndarray, of: np.ndarray, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Objects under the key: (position in parents, place, value)."""
        at = np.full(s.boxes + 1, -1, dtype=np.int64)
        at[parents] = np.arange(len(parents))
        held = s.keyed(name, any_case=True)
        held = held[s.owner[held] >= 0]
        held = held[at[s.owner[held]] >= 0]
        alone, lists = held[s.char[held] == OPEN_O], held[s.char[held] == OPEN_A]
        i, v = s.children(s.inner[lists])
        v_ok = s.char[v] == OPEN_O
        i, v = i[v_ok], v[v_ok]
        who = np.concatenate([at[s.owner[alone]], at[s.owner[lists[i]]]])
        return who.astype(np.int64), np.concatenate([np.zeros(len(alone), np.int64), s.place[v]]), np.concatenate([alone, v])

    who, place, value = objects(boxes, feature_of, "wui")
    if "wui" in kinds:
        out.append((feature_of[who], value, "wui", place, np.full(len(value), -1), [s.raw(i) for i in value] if spans else None))
    if "rev" in kinds:
        i, sub, rev = objects(s.inner[value], who, "rev")
        out.append((feature_of[who[i]], rev, "rev", place[i], sub, [s.raw(j) for j in rev] if spans else None))
    return out


def _flat(texts: list[bytes], spans: bool, kinds: set[str]) -> tuple[list, ...]:
    """Columns (text, feature_no, child, child_no, sub_no, span) of the rows of some bodies."""
    s = Spans(texts)
    keys = {k: s.by_box(s.keyed(k)) for k in ("features", "geometry", "geometries", "coordinates", "properties", "type")}
    root = np.arange(s.n_roots)
    held = s.member(np.where(s.char[root] == OPEN_O, s.inner[root], -1), keys["features"])
    listed = np.where(s.char[root] == OPEN_A, s.inner[root], np.where((held >= 0) & (s.char[np.maximum(held, 0)] == OPEN_A), s.inner[np.maximum(held, 0)], -1))
    single = root[(listed < 0) & (s.char[root] == OPEN_O) & (held < 0)]
    _, many = s.children(listed[listed >= 0])
    feature = np.concatenate([single, many]).astype(np.int64)
    number = np.concatenate([np.zeros(len(single), np.int64), s.place[many]])
    real = s.char[feature] == OPEN_O
    feature, number = feature[real], number[real]
    box, text = s.inner[feature], s.text[feature]
    rows: Rows = []
    if "feature" in kinds:
        rows.append((np.arange(len(feature)), feature, "feature", np.full(len(feature), -1), np.full(len(feature), -1), [s.raw(i) for i in feature] if spans else None))
    if "part" in kinds:
        geometry = s.member(box, keys["geometry"])
        bare = (s.member(box, keys["coordinates"]) >= 0) | (s.member(box, keys["geometries"]) >= 0)
        g = np.where((geometry >= 0) & (s.char[np.maximum(geometry, 0)] == OPEN_O), s.inner[np.maximum(geometry, 0)], np.where((geometry < 0) & bare, box, -1))
        of = np.flatnonzero(g >= 0)
        g = g[of]
        owners, lines = [], []
        while len(g):  # a round for each level of geometry collections
            kind = s.member(g, keys["type"])
            co = s.member(g, keys["coordinates"])
            has = (co >= 0) & (s.char[np.maximum(co, 0)] == OPEN_A)
            one, more = has & s.equals(kind, "LineString"), has & s.equals(kind, "MultiLineString")
            i, v = s.children(s.inner[co[more]])
            owners += [of[one], of[more][i]]
            lines += [co[one], v]
            sub = s.member(g, keys["geometries"])
            deeper = (sub >= 0) & (s.char[np.maximum(sub, 0)] == OPEN_A) & s.equals(kind, "GeometryCollection")
            i, v = s.children(s.inner[sub[deeper]])
            ok = s.char[v] == OPEN_O
            of, g = of[deeper][i[ok]], s.inner[v[ok]]
        owner = np.concatenate(owners).astype(np.int64) if owners else np.zeros(0, np.int64)
        line = np.concatenate(lines).astype(np.int64) if lines else owner
        points = np.bincount(s.owner[(s.owner >= 0) & (s.char == OPEN_A)], minlength=s.boxes + 1)
        full = (s.char[line] == OPEN_A) & (points[s.inner[line]] > 0) if len(line) else np.zeros(0, bool)
        owner, line = owner[full], line[full]
        order = np.lexsort((s.start[line], owner))
        owner, line = owner[order], line[order]
        head = np.concatenate([[True], np.diff(owner) != 0]) if len(owner) else np.zeros(0, bool)
        nth = np.arange(len(owner)) - np.maximum.accumulate(np.where(head, np.arange(len(owner)), 0))
        rows.append((owner, line, "part", nth, np.full(len(line), -1), [s.raw(i) for i in line] if spans else None))
    if kinds & {"wui", "rev"}:
        props = s.member(box, keys["properties"])
        char = np.where(props >= 0, s.char[np.maximum(props, 0)], 0)
        plain = np.flatnonzero(char == OPEN_O)
        rows += _wui(s, plain, s.inner[props[plain]], spans, kinds)
        quoted, decoded = [], []
        for i in np.flatnonzero(char == QUOTE):  # properties given as JSON text
            try:
                decoded.append(json.loads(s.raw(props[i])).encode())
                quoted.append(i)
            except ValueError:
                continue
        if quoted:
            inner = Spans(decoded)
            top = np.arange(inner.n_roots)
            top = top[inner.char[top] == OPEN_O]
            rows += _wui(inner, np.array(quoted, dtype=np.int64)[inner.text[top]], inner.inner[top], spans, kinds)
    cols: tuple[list, ...] = ([], [], [], [], [], [])
    for who, _, child, no, sub, span in rows:
        for c, x in zip(cols, (text[who], number[who], [child] * len(who), no, sub, span if span is not None else [None] * len(who))):
            c.extend(x.tolist() if isinstance(x, np.ndarray) else x)
    if "broken" in kinds:
        bad = np.flatnonzero(s.broken).tolist()
        for c, x in zip(cols, (bad, [-1] * len(bad), ["broken"] * len(bad), [-1] * len(bad), [-1] * len(bad), [None] * len(bad))):
            c.extend(x)
    return cols


def flattened(packets: DataFrame, id_col: str, body: str, kinds: tuple[str, ...] = ("part", "wui", "rev"), spans: bool = False) -> DataFrame:
    """Linked rows of the asked-for ``kinds``: ``feature``, ``part``, ``wui``, ``rev`` and ``broken``.

    Columns: the packet's id, feature_no, child, child_no, sub_no and, with ``spans``, the span of body text. Null
    and empty bodies have no rows; bodies whose quotes or brackets don't pair up have one ``broken`` row, if asked
    for. Null entries have no row but keep their place in the numbering. Packets sent again are told apart by id.
    """
    wanted = set(kinds)
    df = packets.select(F.col(id_col).alias("id"), F.encode(F.col(body), "UTF-8").alias("body")).where(F.col("body").isNotNull())
    kind = df.schema["id"].dataType.simpleString()
    schema = f"{id_col} {kind}, feature_no int, child string, child_no int, sub_no int" + ", span string" * spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column("body").to_pylist()
            ends = np.cumsum([len(x) for x in bodies])
            begin = 0
            while begin < len(bodies):
                limit = (ends[begin - 1] if begin else 0) + CHUNK_BYTES
                stop = max(begin + 1, int(np.searchsorted(ends, limit, side="right")))
                text, feature, child, no, sub, span = _flat(bodies[begin:stop], spans, wanted)
                ids = batch.column("id").take(pa.array([begin + t for t in text], pa.int64()))
                arrays = {id_col: ids, "feature_no": pa.array(feature, pa.int32()), "child": pa.array(child, pa.string()), "child_no": pa.array(no, pa.int32()), "sub_no": pa.array(sub, pa.int32())}
                if spans:
                    arrays["span"] = pa.array(span, pa.string())
                yield pa.RecordBatch.from_pydict(arrays)
                begin = stop

    return df.mapInArrow(run, schema)


def _member(span: str, *names: str) -> F.Column:
    return F.get_json_object(F.col(span), "$." + ".".join(names))


def features(packets: DataFrame, id_col: str, body: str) -> DataFrame:
    """A row per feature: its own members and the scalar properties. HU, which has a member per year, is ``hu``."""
    df = flattened(packets, id_col, body, ("feature",), spans=True)
    # properties may be an object or its JSON text: both come back from get_json_object as the object's text
    p = df.withColumn("_p", _member("span", "properties"))
    return p.select(
        id_col, "feature_no",
        _member("span", "id").alias("feature_id"),
        _member("span", "geometry", "type").alias("geometry_type"),
        _member("_p", "OBJECTID").try_cast("double").cast("long").alias("objectid"),
        _member("_p", "PBG00").alias("pbg00"),
        _member("_p", "RANK").try_cast("int").alias("rank"),
        _member("_p", "TYPE").alias("type"),
        _member("_p", "id").alias("id"),
    )


def hu(packets: DataFrame, id_col: str, body: str) -> DataFrame:
    """A row per member of a feature's HU object: its name and its number."""
    df = flattened(packets, id_col, body, ("feature",), spans=True)
    shares = F.from_json(_member("_p", "HU"), "map<string,double>")
    return df.withColumn("_p", _member("span", "properties")).select(id_col, "feature_no", F.explode(shares).alias("hu_name", "hu_share"))


def parts(packets: DataFrame, id_col: str, body: str) -> DataFrame:
    """A row per line of a geometry, linked to its feature, with its points as [x, y(, z)]."""
    df = flattened(packets, id_col, body, ("part",), spans=True)
    return df.select(id_col, "feature_no", F.col("child_no").alias("part_no"), F.from_json("span", "array<array<double>>").alias("points"))


def points(packets: DataFrame, id_col: str, body: str) -> DataFrame:
    """A row per point of a line part, linked to it: place, x, y and z (null in two dimensions)."""
    at = lambda i: F.get("_xy", F.lit(i))
    df = parts(packets, id_col, body).select(id_col, "feature_no", "part_no", F.posexplode("points").alias("point_no", "_xy"))
    return df.select(id_col, "feature_no", "part_no", "point_no", at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))


def wui(packets: DataFrame, id_col: str, body: str) -> DataFrame:
    """A row per WUI record, linked to its feature."""
    df = flattened(packets, id_col, body, ("wui",), spans=True)
    return df.select(
        id_col, "feature_no", F.col("child_no").alias("wui_no"),
        _member("span", "YEAR").try_cast("int").alias("year"), _member("span", "FLAG").try_cast("int").alias("flag"),
        _member("span", "CLASS").alias("class"), _member("span", "SRC", "SHEET").alias("src_sheet"), _member("span", "SRC", "BY", "CREW").try_cast("int").alias("src_crew"),
    )


def rev(packets: DataFrame, id_col: str, body: str) -> DataFrame:
    """A row per REV record, linked to its WUI record."""
    df = flattened(packets, id_col, body, ("rev",), spans=True)
    return df.select(
        id_col, "feature_no", F.col("child_no").alias("wui_no"), F.col("sub_no").alias("rev_no"),
        _member("span", "NO").try_cast("int").alias("no"), _member("span", "VEG01PC").try_cast("double").alias("veg01pc"),
    )
