from pyspark.sql import functions as F

from geolathe import layer as L
from geolathe.plans.sampling import hashed_sample
from geolathe.plans.skew import salted_join


def test_sample_is_bounded_and_repeatable(spark):
    df = spark.range(20_000).withColumn("t", F.lit("x"))
    a = [r["id"] for r in hashed_sample(df, ["id"], 500, 20_000).collect()]
    b = [r["id"] for r in hashed_sample(df.repartition(7), ["id"], 500, 20_000).collect()]
    assert len(a) == 500 and a == b
    assert hashed_sample(df.limit(3), ["id"], 500, 3).count() == 3


def test_row_numbers_follow_the_partitions(spark, monkeypatch):
    df = spark.range(0, 1000, 1, 13).where("id % 3 <> 0")
    for limit in (1_000, 0):
        monkeypatch.setattr(L, "LITERALS", limit)
        rows = L.with_fid(df).orderBy("_fid").collect()
        assert [r["_fid"] for r in rows] == list(range(len(rows))) and [r["id"] for r in rows] == [i for i in range(1000) if i % 3]
    assert L.with_fid(df.limit(0)).count() == 0
    ordered = L.with_fid(spark.range(0, 5000, 1, 8).orderBy(F.desc("id")), shuffled=True).orderBy("_fid").collect()
    assert [r["id"] for r in ordered] == list(range(4999, -1, -1))


def test_salted_join_equals_a_plain_one(spark):
    left = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, F.lit(7)).otherwise(F.col("id") % 50).cast("long").alias("k"))
    left = left.unionByName(spark.createDataFrame([(9001, None)], "id bigint, k bigint"))
    right = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("left", "inner"):
        want = sorted(map(str, left.join(right, "k", how).select("id", "k", "v").collect()))
        got = sorted(map(str, salted_join(left, right, ["k"], F.col("id"), how, share=0.1, least=10).select("id", "k", "v").collect()))
        assert got == want
