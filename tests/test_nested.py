import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from geolathe.functions.jsonspans import Spans
from geolathe.operators import nested as N

JSON = st.recursive(st.none() | st.booleans() | st.integers() | st.text(alphabet='ab"\\{}[],: é\n', max_size=6), lambda c: st.lists(c, max_size=4) | st.dictionaries(st.text(alphabet='ab"\\{}', max_size=4), c, max_size=4), max_leaves=12)


@settings(max_examples=60, deadline=None)
@given(st.lists(JSON, min_size=1, max_size=4), st.sampled_from([None, 1]))
def test_spans_are_the_values_of_the_texts(values, indent):
    texts = [json.dumps(v, indent=indent, ensure_ascii=False) for v in values]
    s = Spans([t.encode() for t in texts])
    assert not s.broken.any()

    def count(v):
        return 1 + (sum(map(count, v)) if isinstance(v, list) else sum(map(count, v.values())) if isinstance(v, dict) else 0)

    assert len(s.start) == sum(map(count, values))
    assert [json.loads(s.raw(i)) for i in range(s.n_roots)] == values
    for i in range(s.n_roots, len(s.start)):
        json.loads(s.raw(i))


def test_broken_texts_do_not_reach_into_others():
    s = Spans([b'{"a":[1,2]}', b'{"a":"x', b"[1,2", b"]", b'{"a":1]', b"", b'[3,"]"]'])
    assert s.broken.tolist() == [False, True, True, True, True, False, False]
    assert s.raw(s.n_roots - 1) == '[3,"]"]'


def feature(geometry, properties):
    return {"type": "Feature", "geometry": geometry, "properties": properties}


def test_children_of_all_outer_shapes(spark):
    line = {"type": "LineString", "coordinates": [[0, 0], [1, 1, 9]]}
    many = {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1]], [], [[2, 2], [3, 3]]]}
    both = {"type": "GeometryCollection", "geometries": [None, line, {"type": "GeometryCollection", "geometries": [many]}, {"type": "Point", "coordinates": [1, 2]}]}
    props = {"wui": [{"YEAR": 1, "REV": [{"NO": 1}, None, {"NO": 2}]}, None, {"YEAR": 2, "REV": None}], "NOTE": 'a "WUI": [{}]'}
    bodies = [
        json.dumps(feature(line, {"WUI": {"YEAR": 3}})),
        json.dumps({"type": "FeatureCollection", "features": [None, feature(both, props), feature(None, None)]}, indent=2),
        json.dumps([feature({"type": "LineString", "coordinates": []}, json.dumps(props)), {"type": "Feature"}]),
        "[]", "", None, "{broken", json.dumps(line),
    ]
    df = spark.createDataFrame([(i, b, "clash") for i, b in enumerate(bodies)], "packet_id bigint, body string, child string")
    got = {tuple(r) for r in N.flattened(df, "packet_id", "body", ("part", "wui", "rev", "broken")).collect()}
    revs = lambda p, f: {(p, f, "wui", 0, -1), (p, f, "wui", 2, -1), (p, f, "rev", 0, 0), (p, f, "rev", 0, 2)}
    assert got == {(0, 0, "part", 0, -1), (0, 0, "wui", 0, -1), (7, 0, "part", 0, -1), (6, -1, "broken", -1, -1)} | {(1, 1, "part", i, -1) for i in range(3)} | revs(1, 1) | revs(2, 0)
    assert {r["points"][1][0] for r in N.parts(df, "packet_id", "body").collect()} == {1.0, 3.0}
    assert {(r["packet_id"], r["wui_no"], r["year"]) for r in N.wui(df, "packet_id", "body").collect()} == {(0, 0, 3), (1, 0, 1), (1, 2, 2), (2, 0, 1), (2, 2, 2)}
    assert N.features(df, "packet_id", "body").count() == 6
    assert N.rev(df.limit(0), "packet_id", "body").count() == 0


def test_long_and_many_bodies_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(N, "CHUNK_BYTES", 2_000)
    rng = random.Random(2)
    bodies = [json.dumps([feature({"type": "LineString", "coordinates": [[0, 0]] * rng.randrange(1, 300)}, {"WUI": [{}] * rng.randrange(4)}) for _ in range(rng.randrange(5))]) for _ in range(40)]
    rows, want = N._flat([b.encode() for b in bodies], False, {"part", "wui"}), 0
    want = sum(1 + len(f["properties"]["WUI"]) for b in bodies for f in json.loads(b))
    assert len(rows[0]) == want
    df = spark.createDataFrame(list(enumerate(bodies)), "packet_id bigint, body string")
    assert N.flattened(df, "packet_id", "body", ("part", "wui")).count() == want
