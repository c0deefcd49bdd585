import math
import random

from geolathe.operators import proximity as P

RNG = random.Random(4)


def points(spark, rows):
    return spark.createDataFrame(rows, "id bigint, x double, y double, cell string, tile string")


def brute(rows, radius):
    ok = [r for r in rows if None not in r[:3] and not math.isnan(r[1])]
    return {(min(a[0], b[0]), max(a[0], b[0])) for i, a in enumerate(ok) for b in ok[:i] if (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= radius**2}


ROWS = [(i, RNG.uniform(-100, 100), RNG.uniform(-100, 100), "c", "t") for i in range(300)] + [(300 + i, 5.0, 5.0, None, None) for i in range(5)] + [(400, None, 1.0, "", ""), (401, float("nan"), 1.0, "", ""), (402, 3.0, None, "", "")]


def test_planar_pairs_equal_brute_force(spark):
    got = [tuple(r) for r in P.near_planar(points(spark, ROWS), "id", "x", "y", 12.0).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(ROWS, 12.0)


def test_full_cells_are_cut_into_blocks_without_losing_pairs(spark, monkeypatch):
    rows = [(i, RNG.uniform(0, 5), RNG.uniform(0, 5), "c", "t") for i in range(250)] + ROWS[:50]
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    monkeypatch.setattr(P, "BLOCK", 20)
    for sent in (20_000, 0):
        monkeypatch.setattr(P, "SENT_CELLS", sent)
        got = [tuple(r) for r in P.near_planar(points(spark, rows), "id", "x", "y", 2.0).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows, 2.0)
    both = P.near_pairs_between(points(spark, rows[:200]), points(spark, rows[200:]), "id", 2.0)
    assert {(min(r), max(r)) for r in both.collect()} == {p for p in brute(rows, 2.0) if p[0] < 200 <= p[1]}


def test_counts_of_copies_are_not_expanded(spark):
    got = {r["id"]: (r["place"], r["n_near"]) for r in P.near_counts(points(spark, ROWS), "id", "x", "y", 12.0).collect()}
    pairs = brute(ROWS, 12.0)
    for i in (0, 17, 301, 304):
        assert got[i][1] == sum(i in p for p in pairs)
    assert got[303][0] == 300 and 400 not in got


def test_sphere_across_the_antimeridian_and_poles(spark):
    rows = [(i, RNG.uniform(-180, 180), RNG.uniform(-90, 90), "", "") for i in range(200)]
    rows += [(500, 179.99, 10.0, "", ""), (501, -179.99, 10.0, "", ""), (502, 0.0, 89.9, "", ""), (503, 180.0, 89.9, "", ""), (504, 77.0, 90.0, "", "")]
    radius = 900_000.0

    def far(a, b):
        la, lb = math.radians(a[2]), math.radians(b[2])
        h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * P.EARTH_M * math.asin(math.sqrt(min(1, h)))

    want = {(min(a[0], b[0]), max(a[0], b[0])) for i, a in enumerate(rows) for b in rows[:i] if far(a, b) <= radius}
    got = [tuple(r) for r in P.near_sphere(points(spark, rows), "id", "x", "y", radius).collect()]
    assert len(got) == len(set(got)) and set(got) == want and (500, 501) in want and (502, 503) in want


SHAPES = [
    (1, [[[[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0]], [[2.0, 2.0], [4.0, 2.0], [4.0, 4.0], [2.0, 4.0], [2.0, 2.0]]]]),
    (2, [[[[2.0, 2.0], [4.0, 2.0], [4.0, 2.0], [4.0, 4.0], [2.0, 4.0]]], [[[20.0, 20.0], [30.0, 20.0], [25.0, 30.0]]]]),
    (3, None), (4, []), (5, [[]]),
]


def test_containment_both_ways(spark):
    rows = [(i, RNG.uniform(-1, 31), RNG.uniform(-1, 31), "", "") for i in range(400)] + [(900, 3.0, 3.0, "", ""), (901, 0.0, 5.0, "", ""), (902, None, 5.0, "", "")]
    regions = spark.createDataFrame(SHAPES, "region_id bigint, coordinates array<array<array<array<double>>>>")

    def inside(x, y):
        out = set()
        square = 0 <= x <= 10 and 0 <= y <= 10
        hole = 2 < x < 4 and 2 < y < 4
        if square and not hole:
            out.add(1)
        if 2 <= x <= 4 and 2 <= y <= 4:
            out.add(2)
        if 20 <= y <= 30 and abs(x - 25) <= (30 - y) / 2:
            out.add(2)
        return out

    want = {(i, r) for i, x, y, *_ in rows if x is not None for r in inside(x, y)}
    for limit in (1_000_000, 0):
        got = [tuple(r) for r in P.containing(points(spark, rows), "id", "x", "y", regions, "region_id", "coordinates", limit).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    huge = spark.createDataFrame([*SHAPES, (6, [[[[-1e7, -1e7], [1e7, -1e7], [1e7, 1e7], [-1e7, 1e7]]]])], "region_id bigint, coordinates array<array<array<array<double>>>>")
    small = huge.unionByName(spark.createDataFrame([(100 + i, [[[[1e3 + i, 0.0], [1e3 + i, 1e-3], [1e3 + i + 1e-3, 0.0]]]]) for i in range(2000)], huge.schema))
    got = {tuple(r) for r in P.containing(points(spark, rows), "id", "x", "y", small, "region_id", "coordinates", 0).collect()}
    assert got == want | {(i, 6) for i, x, *_ in rows if x is not None}
    assert P.containing(points(spark, rows[:0]), "id", "x", "y", regions, "region_id", "coordinates").count() == 0
