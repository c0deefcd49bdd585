"""Colouring, clustering, hulls of points and smoothing, against conditions that their results must meet."""

import math
import random

from pyspark.sql import functions as F

from geolathe.functions import geometry as G
from geolathe.layer import GEOM, Layer
from geolathe.operators import paths as PA
from geolathe.operators import topology as TO
from geolathe.session import written

SHAPE, POINT = "array<array<array<double>>>", "array<array<double>>"


def grid(spark, n=5):
    box = lambda x, y: [[[float(x), float(y)], [float(x), y + 1.0], [x + 1.0, y + 1.0], [x + 1.0, float(y)], [float(x), float(y)]]]
    return Layer(spark.createDataFrame([(y * n + x, box(x, y)) for y in range(n) for x in range(n)], f"_fid bigint, {GEOM} {SHAPE}"), "grid", "polygon")


def beside(a, b, n=5):
    return abs(a % n - b % n) + abs(a // n - b // n) == 1


def test_neighbours_get_other_colours(spark):
    got = {r["_fid"]: r["class"] for r in TO.coloured(grid(spark), 4).collect()}
    assert len(got) == 25 and set(got.values()) <= set(range(4))
    assert not [(a, b) for a in got for b in got if beside(a, b) and got[a] == got[b]]


def test_clusters_are_connected_and_bounded(spark):
    got = {r["_fid"]: r["cluster"] for r in TO.cluster(grid(spark), pct=0.3, max_area=4.0).df.collect()}
    members: dict = {}
    for f, c in got.items():
        members.setdefault(c, set()).add(f)
    assert len(got) == 25 and 7 <= len(members) <= 8
    for m in members.values():
        assert len(m) <= 4
        reached, todo = set(), [min(m)]
        while todo:
            a = todo.pop()
            reached.add(a)
            todo += [b for b in m - reached if beside(a, b)]
        assert reached == m


def clouds(spark):
    rows = [(10.0 * k + x, float(y)) for k in range(2) for x in range(4) for y in range(4)] + [(100.0, 100.0)]
    return Layer(spark.createDataFrame([(i, [[x, y]]) for i, (x, y) in enumerate(rows)], f"_fid bigint, {GEOM} {POINT}"), "p", "point")


def test_hulls_of_clouds_and_lone_points(spark):
    areas = [round(r[0], 9) for r in TO.alpha_shapes(clouds(spark), 1.5).settled.select(G.area(F.col(GEOM))).collect()]
    assert areas == [9.0, 9.0]
    assert sorted(r["_fid"] for r in TO.filter_points(clouds(spark), 1.5).df.collect()) == list(range(32))


def test_points_close_together_are_linked_by_few_rows(spark, monkeypatch):
    from geolathe.operators import classify, proximity

    rows = []

    def counted(df, name, by=None):
        out = written(df, name, by)
        rows.append(out.count())
        return out

    for m in (classify, proximity, TO):
        monkeypatch.setattr(m, "written", counted)
    rng = random.Random(7)
    copies = [(float(k % 3), float(k // 3 % 2)) for k in range(600)]
    crowd = [(50 + rng.random(), rng.random()) for _ in range(300)]
    beyond = [(50.5 + dx, 2.4 + dy) for dx, dy in ((0.0, 0.0), (0.5, 0.0), (0.0, 0.5))]  # less than the interval from the crowd, not of a cell that touches
    x = Layer(spark.createDataFrame([(i, [[x, y]]) for i, (x, y) in enumerate(copies + crowd + beyond)], f"_fid bigint, {GEOM} {POINT}"), "p", "point")
    shapes = {r["_fid"]: r["a"] for r in TO.alpha_shapes(x, 1.9).settled.select("_fid", G.area(F.col(GEOM)).alias("a")).collect()}
    assert set(shapes) == {0, 600} and shapes[0] == 2.0
    assert sorted(r["_fid"] for r in TO.filter_points(x, 1.9).df.collect()) == list(range(903))
    assert max(rows) <= 2 * 903


def test_groups_of_points_are_those_of_all_pairs(spark):
    rng = random.Random(8)
    for d, n, w in ((1.0, 150, 8.0), (3.0, 60, 20.0)):
        pts = [(rng.uniform(-w, w), rng.uniform(-w, w)) for _ in range(n)]
        pts += [(x + d, y) for x, y in pts[:5]] + [(float("inf"), 0.0), (float("inf"), 1.0)]
        df = spark.createDataFrame([(i, [[x, y]]) for i, (x, y) in enumerate(pts)], f"_fid bigint, {GEOM} {POINT}")
        got = {(r["x"], r["y"]): r["g"] for r in TO._linked(TO._placed(Layer(df, "p", "point")), d).collect()}
        pts = pts[:-2]
        expected = list(range(len(pts)))
        for _ in pts:
            expected = [min(g for g, q in zip(expected, pts) if (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 <= d * d) for p in pts]
        assert got == dict(zip(pts, expected)) and len(set(expected)) > 5


def test_smoothing_takes_out_noise(spark):
    rng = random.Random(5)
    ring = [[math.cos(-a * math.pi / 60) * (1 + rng.uniform(-0.02, 0.02)), math.sin(-a * math.pi / 60) * (1 + rng.uniform(-0.02, 0.02))] for a in range(120)]
    line = [[float(i), 0.0] for i in range(20)]
    x = Layer(spark.createDataFrame([(0, [[*ring, ring[0]]]), (1, None)], f"_fid bigint, {GEOM} {SHAPE}"), "r", "polygon")
    y = {r["_fid"]: r for r in PA.smooth(x, 0.3).settled.select("_fid", G.area(F.col(GEOM)).alias("a"), G.length(F.col(GEOM)).alias("l")).collect()}
    before = x.df.select(G.length(F.col(GEOM))).first()[0]
    assert y[0]["l"] < before and abs(y[0]["a"] - math.pi) < 0.15 and y[1]["a"] is None
    straight = Layer(spark.createDataFrame([(0, [line])], f"_fid bigint, {GEOM} {SHAPE}"), "l", "polyline")
    part = PA.smooth(straight, 2.0).df.first()[GEOM][0]
    assert part[0] == line[0] and part[-1] == line[-1] and all(abs(p[1]) < 1e-9 for p in part)


def test_a_share_of_the_vertices_is_kept(spark):
    rng = random.Random(6)
    lines = [[[float(i), rng.uniform(0, 1)] for i in range(k, k + 40)] for k in range(0, 400, 40)]
    x = Layer(spark.createDataFrame([(i, [p]) for i, p in enumerate(lines)], f"_fid bigint, {GEOM} {SHAPE}"), "l", "polyline")
    for method in ("weighted", "visvalingam", "dp"):
        parts = [r[GEOM][0] for r in PA.simplify(x, percentage=0.25, method=method).df.orderBy("_fid").collect()]
        assert all(p[0] == q[0] and p[-1] == q[-1] and all(v in q for v in p) for p, q in zip(parts, lines))
        assert 0 <= sum(len(p) - 2 for p in parts) - 0.25 * 380 <= 8  # vertices that go together have one threshold
