"""Gaps that reach over tiles of the map, and loops that once stopped early."""

import pytest
from pyspark.sql import functions as F

from geolathe.functions import geometry as G
from geolathe.layer import GEOM, Layer
from geolathe.operators import overlay as O


def box(*corners):
    x0, y0, x1, y1 = map(float, corners)
    return [[[x0, y0], [x0, y1], [x1, y1], [x1, y0], [x0, y0]]]


#: Four boxes around a hole of the size 1, another hole beside it, and a notch that is open to the outside.
BOXES = [box(0, 0, 3, 1), box(0, 2, 3, 3), box(0, 1, 1, 2), box(2, 1, 3, 2), box(3, 0, 4, 3), box(5, 0, 6, 3), box(4, 0, 5, 0.5), box(4, 2.5, 5, 3), box(6, 0, 9, 1), box(6, 2, 9, 3)]


def layer(spark):
    return Layer(spark.createDataFrame([(i, f"n{i}", b) for i, b in enumerate(BOXES)], f"_fid bigint, name string, {GEOM} array<array<array<double>>>"), "boxes", "polygon")


@pytest.mark.parametrize("vertices", [20_000, 20, 4])
def test_gaps_are_filled_on_any_number_of_tiles(spark, monkeypatch, vertices):
    monkeypatch.setattr(O, "TILE_VERTICES", vertices)
    solid = sum((b[0][2][0] - b[0][0][0]) * (b[0][2][1] - b[0][0][1]) for b in BOXES)

    def area(gap):
        return round(O.clean(layer(spark), gap_area=gap).settled.agg(F.sum(G.area(F.col(GEOM)))).first()[0], 9)

    assert area(1.5) == solid + 1  # the hole of size 1; the other is 1 x 2, the notch isn't enclosed
    assert area(2.5) == solid + 3
    assert area(0.5) == solid


@pytest.mark.parametrize("vertices", [20_000, 10])
def test_mosaic_and_union_are_the_same_on_any_number_of_tiles(spark, monkeypatch, vertices):
    monkeypatch.setattr(O, "TILE_VERTICES", vertices)
    tilted = [[[[0.5, -0.5], [-0.7, 1.5], [2.2, 3.4], [4.1, 0.3], [0.5, -0.5]], [[1.2, 1.2], [1.9, 1.1], [1.4, 1.9], [1.2, 1.2]]], [[[2.0, 1.0], [3.3, 4.0], [6.2, 1.7], [2.0, 1.0]]]]
    other = Layer(spark.createDataFrame([(i, f"t{i}", b) for i, b in enumerate(tilted)], f"_fid bigint, other string, {GEOM} array<array<array<double>>>"), "tilted", "polygon")
    got = O.union([layer(spark), other]).settled.groupBy("name", "other").agg(F.round(F.sum(G.area(F.col(GEOM))), 6).alias("a")).collect()
    pairs = {(r["name"], r["other"]): r["a"] for r in O.overlap_areas(layer(spark), other).withColumn("name", F.concat(F.lit("n"), "_t")).withColumn("other", F.concat(F.lit("t"), "_s")).select("name", "other", F.round("area", 6).alias("a")).collect()}
    both = {(r["name"], r["other"]): r["a"] for r in got if r["name"] and r["other"]}
    # the two tilted ones overlap: a tile in both has the first one's name
    for k, a in pairs.items():
        if k[1] == "t0":
            assert abs(both[k] - a) < 1e-5
    assert abs(sum(r["a"] for r in got if r["name"]) - sum((b[0][2][0] - b[0][0][0]) * (b[0][2][1] - b[0][0][1]) for b in BOXES)) < 1e-5
