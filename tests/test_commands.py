"""Command strings over small inputs, after what the commands are documented to do."""

import json
import math
import random

import pytest

from geolathe.functions import projections as PR
from geolathe.functions import shapes as S
from geolathe.functions.expressions import ExpressionError
from geolathe.layer import LayerError
from geolathe.plans.commands import CommandError, amount, parse
from geolathe.plans.pipeline import Pipeline, apply_commands


def square(x, y, s=1.0):
    return [[[x, y], [x, y + s], [x + s, y + s], [x + s, y], [x, y]]]


def collection(*features):
    return json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": p, "geometry": {"type": t, "coordinates": c} if c else None} for t, c, p in features]})


SQUARES = collection(("Polygon", square(0, 0), {"n": "a", "v": 1}), ("Polygon", square(1, 0), {"n": "b", "v": 2}), ("Polygon", square(0, 1), {"n": "a", "v": 3}), ("Polygon", square(1, 1), {"n": "", "v": 4}))


def run(spark, text, **inputs):
    out = apply_commands(spark, text, {k.replace("_", "."): v for k, v in inputs.items()})
    return next(iter(out.values()))


def rows(spark, text, **inputs):
    p = Pipeline(spark, {k.replace("_", "."): v for k, v in inputs.items()}).run(text)
    return [r.asDict(recursive=True) for r in p.layer().ordered().collect()]


def test_joins(spark):
    types = "type\na\nb\na\nb\nb"
    assert run(spark, "-i t.csv -join t.csv keys=type,type calc='n = count()' -o out.csv", t_csv=types) == "type,n\na,2\nb,3\na,2\nb,3\nb,3"
    a, b = "id,name\n1,foo\n2,bar", "key,score\n1,100\n1,200\n1,300"
    assert run(spark, "-i a.csv -join b.csv keys=id,key duplication -o out.csv", a_csv=a, b_csv=b) == "id,name,score\n1,foo,100\n2,bar,\n1,foo,200\n1,foo,300"
    assert rows(spark, "-i a.csv -join b.csv keys=id,key calc='n=count(), m=average(score)' fields=", a_csv=a, b_csv=b)[1] == {"id": 2.0, "name": "bar", "n": 0.0, "m": None}
    assert rows(spark, "-i a.csv -join b.csv keys=id,key sum-fields=score", a_csv=a, b_csv=b)[0]["score"] == 600.0
    assert [r["score"] for r in rows(spark, "-i a.csv -join b.csv keys=id,key where='isMax(score)'", a_csv=a, b_csv=b)] == [300.0, None]
    with pytest.raises(LayerError):
        run(spark, "-i a.csv -join b.csv keys=name,key -o", a_csv=a, b_csv=b)
    with pytest.raises(LayerError):
        run(spark, "-i a.json -join b.csv keys=id,key -o", a_json='[{"id":null,"name":"x"}]', b_csv=b)


def test_null_keys_meet_and_existing_fields_stay(spark):
    a, b = '[{"k":"x","v":1},{"k":null,"v":2}]', '[{"k":null,"v":9},{"k":"x","v":8}]'
    assert [r["v"] for r in rows(spark, "-i a.json -join b.json keys=k,k", a_json=a, b_json=b)] == [1, 2]
    assert [r["v"] for r in rows(spark, "-i a.json -join b.json keys=k,k force", a_json=a, b_json=b)] == [8, 9]
    assert [r["p_v"] for r in rows(spark, "-i a.json -join b.json keys=k,k prefix=p_", a_json=a, b_json=b)] == [8, 9]


def test_aggregates(spark):
    t = "g,v\nb,1\na,5\nb,\na,5\nb,3\nb,3"
    got = rows(spark, "-i t.csv -dissolve g calc='n=count(), s=sum(v), m=mean(v), d=median(v), o=mode(v), c=collect(v), f=first(v), l=last(v), e=every(v > 0), q=max(v) - min(v)'", t_csv=t)
    assert got[0] == {"g": "b", "n": 4.0, "s": 7.0, "m": 1.75, "d": 2.0, "o": 3.0, "c": [1.0, None, 3.0, 3.0], "f": 1.0, "l": 3.0, "e": False, "q": 2.0}
    assert got[1]["g"] == "a" and got[1]["o"] == 5.0
    assert [r["v"] for r in rows(spark, "-i t.csv -dissolve where='g == \"a\"' copy-fields=v", t_csv=t)] == [1.0, None, 3.0, 3.0, 5.0]
    assert run(spark, "-i t.csv -calc 'sum(v)' + -target info -o out.csv", t_csv=t) == "expression,value,layer_name\nsum(v),17,t"
    assert rows(spark, "-i t.csv -calc 'total = sum(v)' -each 'p = v / total' -filter 'v == 3'", t_csv=t)[0]["p"] == 3 / 17
    with pytest.raises(ExpressionError):
        run(spark, "-i t.csv -dissolve g calc='x = v > 1 ? sum(v) : 0' -o", t_csv=t)


def test_rows_and_fields(spark):
    t = "k,v\na,2\nb,\na,1\na,3\nc,9"
    assert [r["v"] for r in rows(spark, "-i t.csv -sort v descending", t_csv=t)] == [9.0, 3.0, 2.0, 1.0, None]
    assert [r["v"] for r in rows(spark, "-i t.csv -sort v", t_csv=t)] == [1.0, 2.0, 3.0, 9.0, None]
    assert [r["v"] for r in rows(spark, "-i t.csv -uniq k", t_csv=t)] == [2.0, None, 9.0]
    assert [r["v"] for r in rows(spark, "-i t.csv -uniq k max-count=2", t_csv=t)] == [2.0, None, 1.0, 9.0]
    assert [r["v"] for r in rows(spark, "-i t.csv -uniq k invert", t_csv=t)] == [1.0, 3.0]
    assert [r["index"] for r in rows(spark, "-i t.csv -uniq k index", t_csv=t)] == [1, 1, 2, 3, 1]
    assert list(rows(spark, "-i t.csv -filter-fields w=v,k", t_csv=t)[0]) == ["w", "k"]
    with pytest.raises(ExpressionError):
        run(spark, "-i t.csv -filter 'v + 1' -o", t_csv=t)
    with pytest.raises(LayerError):
        run(spark, "-i t.csv -rename-fields z=q -o", t_csv=t)
    p = Pipeline(spark, {"t.csv": t}).run("-i t.csv -split k")
    assert list(p.layers) == ["a", "b", "c"] and p.layers["a"].df.count() == 3
    with pytest.raises(LayerError):
        run(spark, "-i a.csv b.csv -merge-layers -o", a_csv="x\n1", b_csv="y\n1")
    assert rows(spark, "-i a.csv b.csv -merge-layers force", a_csv="x\n1", b_csv="y\n2") == [{"x": 1.0, "y": None}, {"x": None, "y": 2.0}]


def test_control_flow_and_variables(spark):
    t = "v\n1\n2\n3"
    assert [r["q"] for r in rows(spark, "-i t.csv -vars k=2 -filter 'v >= {{k}}' -if 'this.size > 5' -each 'q=0' -elif 'this.size == 2' -each 'q=1' -else -each 'q=2' -endif", t_csv=t)] == [1.0, 1.0]
    assert [r["w"] for r in rows(spark, "-i t.csv -define 'f = x => x * 10, k = 3' -each 'w = f(v) + k'", t_csv=t)] == [13.0, 23.0, 33.0]
    assert rows(spark, "-i t.csv -run 'sub.txt'", t_csv=t, sub_txt="-each 'z = v' -filter 'z > 2'") == [{"v": 3.0, "z": 3.0}]
    assert Pipeline(spark, {"t.csv": t}, {"double": lambda x, o: x.with_df(x.df.selectExpr("_fid", "v * 2 AS v"))}).run("-i t.csv -double").layer().df.count() == 3
    with pytest.raises(CommandError):
        run(spark, "-i t.csv -nonsense", t_csv=t)
    assert [c.name for c in parse("-i a.csv -filter 'a-b > -1' -o x.csv")] == ["i", "filter", "o"]
    assert amount("2km") == 2000 and amount("1sqkm") == 1e6 and amount("5%") == 0.05


def test_classify(spark):
    t = "v\n" + "\n".join(map(str, [0, 1, 1, 3, 4])) + "\n"
    assert [r["class"] for r in rows(spark, "-i t.csv -classify v breaks=1,4", t_csv=t)] == [0, 1, 1, 1, 2]
    assert [r["class"] for r in rows(spark, "-i t.csv -classify v breaks=4,1", t_csv=t)] == [2, 1, 1, 1, 0]
    assert [r["c"] for r in rows(spark, "-i t.json -classify v breaks=1,4 save-as=c", t_json='[{"v":0},{"v":null}]')] == [0, -1]
    rng = random.Random(3)
    many = "v\n" + "\n".join(str(rng.random()) for _ in range(400))
    counts = [0] * 4
    for r in rows(spark, "-i t.csv -classify v quantile classes=4", t_csv=many):
        counts[r["class"]] += 1
    assert counts == [100] * 4
    nice = {r["class"] for r in rows(spark, "-i t.csv -classify v nice classes=4", t_csv=many)}
    assert nice == {0, 1, 2, 3}
    assert [r["fill"] for r in rows(spark, "-i t.csv -classify v colors=#ff0000,#0000ff categories=0,1 method=categorical other=grey", t_csv=t)][:2] == ["#ff0000", "#0000ff"]
    got = rows(spark, "-i g.json -classify non-adjacent", g_json=SQUARES)
    assert len({r["class"] for r in got}) >= 2


def test_points_and_grids(spark):
    pts = '{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[2,2]},{"type":"Point","coordinates":[3,3]}]}'
    assert len(rows(spark, "-i p.json -point-to-grid interval=1", p_json=pts)) == 7
    assert rows(spark, "-i a.csv -points", a_csv="lng,lat\n1,2\n,3")[0]["_geom"] == [[1.0, 2.0]]
    assert rows(spark, "-i a.csv -points x=a y=b", a_csv="a,b\n12°30′W,10N\nx,1")[0]["_geom"] == [[-12.5, 10.0]]
    assert [r["n"] for r in rows(spark, "-i p.json -i g.json -join p calc='n=count()'", p_json=collection(("Point", [0.5, 0.5], {}), ("Point", [1.0, 0.5], {})), g_json=SQUARES)] == [2.0, 1.0, 0.0, 0.0]
    far = collection(("Point", [0, 0], {"k": 1}), ("Point", [3, 4], {"k": 2}), ("Point", [9, 9], {"k": 3}))
    assert [r["n"] for r in rows(spark, "-i p.json -join p.json max-distance=5 calc='n=count()'", p_json=far)] == [2.0, 2.0, 1.0]
    assert rows(spark, "-i p.json -dissolve calc='n=count()'", p_json=far)[0]["_geom"] == [[4.0, 13 / 3]]
    hexes = rows(spark, "-grid type=hex bbox=0,0,10,10 interval=1")
    assert all(math.isclose(S.ring_area(h["_geom"][0]), 1.5 * math.sqrt(3), rel_tol=1e-9) for h in hexes) and len(hexes) > 35


def area(g):
    return sum(S.ring_area(r) for r in g)


def test_polygons(spark):
    assert {r["n"]: area(r["_geom"]) for r in rows(spark, "-i g.json -dissolve n", g_json=SQUARES)} == {"a": 2.0, "b": 1.0, "": 1.0}
    one = rows(spark, "-i g.json -dissolve", g_json=SQUARES)
    assert len(one) == 1 and len(one[0]["_geom"]) == 1 and area(one[0]["_geom"]) == 4.0
    assert [r["n"] for r in rows(spark, "-i g.json -data-fill n", g_json=SQUARES)] == ["a", "b", "a", "a"]
    assert len(rows(spark, "-i g.json -innerlines", g_json=SQUARES)) == 4
    assert [r["TYPE"] for r in rows(spark, "-i g.json -lines n", g_json=SQUARES)] == ["outer", "n", "inner"]
    assert sum(area(r["_geom"]) for r in rows(spark, "-i g.json -clip bbox=0.5,0.5,1.5,1.5", g_json=SQUARES)) == 1.0
    mask = collection(("Polygon", square(0.5, 0.5), {}))
    assert sum(area(r["_geom"]) for r in rows(spark, "-i m.json -i g.json -erase m", g_json=SQUARES, m_json=mask)) == 3.0
    assert len(rows(spark, "-i g.json m.json -union", g_json=SQUARES, m_json=mask)) == 8
    assert len(rows(spark, "-i g.json -lines -polygons", g_json=SQUARES)) == 4
    donut = collection(("Polygon", [*square(0, 0, 3), [[1, 1], [2, 1], [2, 2], [1, 2], [1, 1]]], {}))
    assert area(rows(spark, "-i d.json", d_json=donut)[0]["_geom"]) == 8.0
    assert area(rows(spark, "-i d.json -drop holes", d_json=donut)[0]["_geom"]) == 9.0
    assert rows(spark, "-i g.json -each 'a = this.area, p = this.perimeter, c = this.centroidX'", g_json=SQUARES)[1]["c"] == 1.5
    assert len(rows(spark, "-i m.json -explode", m_json=collection(("MultiPolygon", [square(0, 0), square(5, 5)], {})))) == 2
    bow = collection(("Polygon", [[[0, 0], [2, 2], [2, 0], [0, 2], [0, 0]]], {}))
    assert Pipeline(spark, {"b.json": bow}).run("-i b.json -check-geometry").messages == ["b: 1 intersections"]
    assert math.isclose(area(rows(spark, "-i b.json -clean", b_json=bow)[0]["_geom"]), 2.0)


def test_simplified_neighbours_keep_their_common_border(spark):
    zig = [[1 + (0.02 if y % 2 else 0), y / 10] for y in range(11)]
    left = [[0, 0], [0, 1], *zig[::-1], [0, 0]]
    right = [[2, 1], [2, 0], *zig, [2, 1]]
    both = collection(("Polygon", [left], {}), ("Polygon", [right], {}))
    got = rows(spark, "-i g.json -simplify 20%", g_json=both)
    assert math.isclose(sum(area(r["_geom"]) for r in got), 2.0, rel_tol=1e-9) and sum(len(r["_geom"][0]) for r in got) < len(left) + len(right)


def test_random_overlays_conserve_area():
    rng = random.Random(7)

    def star(n):
        cx, cy = rng.uniform(0, 2), rng.uniform(0, 2)
        ring = [[cx + rng.uniform(0.3, 1.5) * math.cos(t), cy + rng.uniform(0.3, 1.5) * math.sin(t)] for t in sorted((rng.uniform(0, 2 * math.pi) for _ in range(n)), reverse=True)]
        return [[*ring, ring[0]]]

    for _ in range(25):
        a, b = S.cleaned(star(9)), S.cleaned(star(7))
        inside, outside = area(S.clipped(a, [b])), area(S.clipped(a, [b], True))
        assert math.isclose(inside + outside, area(a), rel_tol=1e-6, abs_tol=1e-9)
        assert math.isclose(inside, area(S.clipped(b, [a])), rel_tol=1e-6, abs_tol=1e-9)


def test_projections_lead_back():
    for name in ("webmercator", "merc", "lcc", "aea", "EPSG:32633", "+proj=laea +lat_0=50 +lon_0=10", "sinu", "moll", "eqc", "robin", "miller", "gall", "natearth", "equalearth", "+proj=cea +lat_ts=30", "+proj=ortho +lat_0=40 +lon_0=10", "+proj=gnom +lat_0=40 +lon_0=10", "+proj=stere +lat_0=40 +lon_0=10", "+proj=aeqd +lat_0=40 +lon_0=10"):
        p = PR.projection(name)
        for x, y in ((12.0, 47.0), (15.5, 52.25), (9.0, -3.0)):
            bx, by = p.inverse(*p.forward(x, y))
            assert abs(bx - x) < 1e-6 and abs(by - y) < 1e-6, name
    x, y = PR.projection("EPSG:32633").forward(15.0, 52.0)
    assert abs(x - 500000) < 1e-6 and abs(y - 5761038.21) < 0.5


def test_coordinates_move_in_batches(spark):
    from geolathe.layer import GEOM, Layer

    shapes = [None if i % 4 == 0 else [[[float(i), 1.0 * j], [i + 1.0, 2.0 * j], [i + 0.5, -1.0], [float(i), 1.0 * j]] for j in range(i % 3)] for i in range(40)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(shapes)], f"_fid bigint, {GEOM} array<array<array<double>>>").repartition(3)
    p = Pipeline(spark, {"a.parquet": Layer(df, "a", "polygon", "wgs84")}).run("-i a.parquet -proj webmercator")
    f = PR.projection("webmercator").forward
    got = {r["_fid"]: r[GEOM] for r in p.layer().df.collect()}
    for i, s in enumerate(shapes):
        want = [[[float(v) for v in f(*q)] for q in part] for part in s] if s else None
        assert (got[i] is None) == (want is None or want == [])
        if want:
            assert all(math.isclose(a, b, abs_tol=1e-6) for g, w in zip(got[i], want) for p1, p2 in zip(g, w) for a, b in zip(p1, p2)) and [len(g) for g in got[i]] == [len(w) for w in want]


def test_delaunay_fills_the_hull():
    rng = random.Random(5)
    pts = [[rng.random(), rng.random()] for _ in range(120)] + [[0, 0], [1, 0], [0, 1], [1, 1]]
    tri = S.delaunay(pts)
    total = sum(abs(S.ring_area([pts[a], pts[b], pts[c], pts[a]])) for a, b, c in tri)
    assert math.isclose(total, 1.0, rel_tol=1e-6)
