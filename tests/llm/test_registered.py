from pathlib import Path

import pytest

from geolathe.llm import queries as Q

ROOT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(ROOT).exists(), reason="test tables aren't here")

COLUMNS = {"p1_found": ["layer", "fid", "field"], "p6_found": ["doc_id"], "p7_found": ["source"], "p8_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, name):
    df = Q.queries()[name](spark, ROOT)
    assert df.columns == COLUMNS.get(name, df.columns) and df.count() >= 0


def test_sources_that_miss_their_share(spark):
    docs = {r["source"]: r["n"] for r in Q._sized(spark, ROOT).groupBy("source").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "n").collect()}
    targets = [r.asDict() for r in Q.table(spark, ROOT, "mix_targets").collect()]
    total = sum(docs.get(t["source"], 0) for t in targets)
    want = {t["source"] for t in targets if docs.get(t["source"], 0) * t["max_repeats"] < t["target_share"] * total}
    assert {r["source"] for r in Q.p7_found(spark, ROOT).collect()} == want
