"""Components of rows that share members, against union-find."""

import random
from pathlib import Path

import duckdb
import pytest

from geolathe.operators.classify import components
from geolathe.queries import reference

ROOT = "/root/testdata/sf0.001"


def union_find(members):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, ms in members.items():
        for m in ms:
            root[find(("id", i))] = find(("m", m))
    least = {}
    for i in sorted(members):
        least.setdefault(find(("id", i)), i)
    return {i: least[find(("id", i))] for i in members}


def test_random_links(spark):
    rng = random.Random(5)
    members = {i: [rng.randrange(400) for _ in range(rng.choice((0, 1, 1, 2)))] for i in range(300)}
    members |= {1000 + i: [f for f in (1000 + i, 1001 + i)] for i in range(150)}  # a chain
    want = union_find(members)
    assert 10 < len(set(want.values())) < 290
    df = spark.createDataFrame(list(members.items()), "id bigint, m array<bigint>")
    assert {r["id"]: r["component"] for r in components(df, "id", "m").collect()} == want


@pytest.mark.skipif(not Path(ROOT).exists(), reason="test tables aren't here")
def test_every_order_has_a_component(spark):
    keys = duckdb.sql(f"SELECT o_orderkey, o_custkey FROM '{ROOT}/orders.parquet'").fetchall()
    want = union_find({o: [c, o // 8 + 10000000] for o, c in keys})
    got = reference.QUERIES["blacki_components"](spark, ROOT).collect()
    assert len(got) == len(keys) and {r["o_orderkey"]: r["component"] for r in got} == want
