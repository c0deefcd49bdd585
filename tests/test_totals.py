"""Running totals, quantiles of large groups, snapping and dissolving polygons that overlap."""

import random

import pytest
from pyspark.sql import functions as F

from geolathe.functions import aggregates as A
from geolathe.functions import geometry as G
from geolathe.functions.expressions import ExpressionError
from geolathe.layer import GEOM, Layer
from geolathe.operators import paths as PA
from geolathe.operators import table as T
from geolathe.plans.pipeline import Pipeline


def test_running_totals(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, 1.0, 2.5, -1.0]), rng.choice("ab")) for i in range(300)]
    x = Layer(spark.createDataFrame(rows, "_fid bigint, v double, k string").repartition(7), "t")
    got = {r["_fid"]: r for r in T.each(x, "global.n = (global.n || 0) + v; total = global.n; i = global.count = global.count + 1; half = global.n / 2").df.collect()}
    total = 0.0
    for i, v, _ in rows:
        total += v or 0.0
        assert abs(got[i]["total"] - total) < 1e-9 and got[i]["i"] == i + 1 and abs(got[i]["half"] - total / 2) < 1e-9
    some = {r["_fid"]: r["n"] for r in T.each(x, "n = global.n = global.n + 1", where="k == 'a'").df.collect()}
    count = 0
    for i, _, k in rows:
        count += k == "a"
        assert some[i] == (count if k == "a" else None)
    assert T.each(x.with_df(x.df.limit(0)), "n = global.n = global.n + 1").df.count() == 0
    with pytest.raises(ExpressionError):
        T.each(x, "global.last = v")


def test_quantiles_by_rank_are_those_of_the_aggregate(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, 0.5, 1.0, 7.25, rng.random()]), rng.choice(["a", "b", None, "c"]) if i else "single") for i in range(400)]
    x = Layer(spark.createDataFrame(rows, "_fid bigint, v double, k string"), "t")
    text = "a = median(v), b = quartile1(v), c = quantile(v, 0.9), d = iqr(v), e = median(v * 2), n = count()"
    want = sorted(map(str, T.dissolve(x, ["k"], text).df.collect())), T.calc(x, text)
    monkeypatch.setattr(A, "LARGE_GROUP", 10)
    got = sorted(map(str, T.dissolve(x, ["k"], text).df.select(*T.dissolve(x, ["k"], text).df.columns).collect())), T.calc(x, text)
    assert [eval(r.replace("Row", "dict")) for r in got[0]] == [pytest.approx(eval(r.replace("Row", "dict"))) for r in want[0]]
    assert got[1] == pytest.approx(want[1])


def box(x0, y0, x1, y1):
    return [[[float(x0), float(y0)], [float(x0), float(y1)], [float(x1), float(y1)], [float(x1), float(y0)], [float(x0), float(y0)]]]


def polygons(spark, rows):
    return Layer(spark.createDataFrame([(i, k, b) for i, (k, b) in enumerate(rows)], f"_fid bigint, k string, {GEOM} array<array<array<double>>>"), "p", "polygon")


def test_snapping_moves_vertices_together(spark):
    near = box(1.0005, 0, 2, 1)
    x = PA.snap(polygons(spark, [("a", box(0, 0, 1, 1)), ("b", near), ("c", None), ("d", box(5, 5, 5.0004, 5.0004))]), 0.001)
    got = {r["k"]: r[GEOM] for r in x.df.collect()}
    assert got["a"] == box(0, 0, 1, 1) and got["b"] == box(1, 0, 2, 1) and got["c"] is None and got["d"] is None


def test_dissolve_repairs_overlaps(spark):
    x = polygons(spark, [("a", box(0, 0, 2, 2)), ("a", box(1, 1, 3, 3)), ("b", box(2, 0, 4, 2)), ("b", box(0, 4, 1, 5)), (None, box(8, 8, 9, 9))])

    def areas(options):
        y = Pipeline(spark, {"x.parquet": x}).run(f"-i x.parquet -dissolve k calc='n = count()' {options}").layer()
        return {r["k"]: (r["n"], round(r["a"], 9)) for r in y.settled.select("k", "n", G.area(F.col(GEOM)).alias("a")).collect()}

    assert areas("") == {"a": (2.0, 7.0), "b": (2.0, 4.0), None: (1.0, 1.0)}  # what a and b share is a's
    assert areas("allow-overlaps") == {"a": (2.0, 7.0), "b": (2.0, 5.0), None: (1.0, 1.0)}
    one = Pipeline(spark, {"x.parquet": x}).run("-i x.parquet -dissolve2").layer()
    assert round(one.settled.select(G.area(F.col(GEOM))).first()[0], 9) == 12.0
