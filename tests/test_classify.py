"""Categories taken from the data."""

from tests.test_commands import rows


def test_every_value_is_a_category(spark):
    names = [f"n{i * 7 % 1500}" for i in range(1500)]
    t = "k\n" + "\n".join([*names, '""', *names[::-1]])
    got = [r["class"] for r in rows(spark, "-i a.csv -classify k", a_csv=t)]
    assert got == [*range(1500), -1, *range(1499, -1, -1)]
    got = [r["v"] for r in rows(spark, "-i a.csv -classify k categories=* values=x,y,z save-as=v", a_csv=t)]
    assert got == [["x", "y", "z"][i % 3] for i in range(1500)] + [None] + [["x", "y", "z"][i % 3] for i in range(1499, -1, -1)]


def test_values_at_ranks_are_exact(spark):
    import random

    from geolathe.operators.classify import ranked_values

    rng = random.Random(4)
    for rows in ([rng.random() for _ in range(5000)], [float(rng.randrange(3)) for _ in range(900)], [1.0], [-2.0, -2.0, 5.0]):
        ranks = sorted({rng.randrange(len(rows)) for _ in range(6)} | {0, len(rows) - 1})
        assert ranked_values(spark.createDataFrame([(v,) for v in rows], "v double").repartition(5), ranks) == [sorted(rows)[r] for r in ranks]
