import datetime as dt

from geolathe.operators import impute as I

SPECS = [I.Filled("county"), I.Filled("no", "code", 1, 60), I.Filled("m", "measure", 0, None)]
SCHEMA = "id bigint, e string, t timestamp, county string, no int, m double, field string, value string"


def day(n):
    return dt.datetime(2020, 1, 1) + dt.timedelta(days=n)


def run(spark, rows):
    df = spark.createDataFrame([(i, *r, "clash", "clash") for i, r in enumerate(rows)], SCHEMA)
    got = I.fills(df, "id", "e", "t", SPECS).collect()
    return {(r["id"], r["field"]): (r["fill"], r["method"], r["distance_days"]) for r in got}, df


def test_fill_by_time(spark):
    rows = [
        ("a", day(0), "Alba", 1, 10.0), ("a", day(10), "n/a", None, None), ("a", day(20), "ALBA ", 2, 20.0),
        ("a", day(900), "?", 999, -1.0), ("b", day(0), None, None, None), (None, day(0), None, 1, None),
        ("a", None, "", None, None), ("c", day(0), "Null Bay", 7, 1.0), ("c", day(0), "(none)", 0, float("nan")), ("c", day(0), "(none)", 0, float("nan")),
    ]
    got, df = run(spark, rows)
    assert got[1, "county"][:2] == ("Alba", "agreed")
    assert got[1, "m"][1] == "interpolated" and float(got[1, "m"][0]) == 15.0
    assert got[1, "no"] == ("1", "carried_forward", 10.0)
    assert got[3, "no"] == ("2", "beyond_gap", 880.0)
    assert got[6, "no"][1] == "any_time"
    assert got[8, "county"] == ("Null Bay", "same_time", 0.0) and got[9, "no"][0] == "7"
    assert not any(i in (4, 5) for i, _ in got)
    wide = {r["id"]: r for r in I.filled_table(df, "id", "e", "t", SPECS).collect()}
    assert len(wide) == len(rows) and wide[1]["no"] == 1 and wide[1]["no_method"] == "carried_forward" and wide[0]["no_method"] is None and wide[4]["county"] is None


def test_every_missing_cell_of_a_known_entity_is_filled(spark):
    import random

    rng = random.Random(1)
    rows = [(rng.choice("abcd"), day(rng.randrange(4) * 400) if rng.random() < 0.9 else None, rng.choice([None, "", "Unknown", "X1", "x1", "Y"]), rng.choice([None, 0, 5, 6, 61]), rng.choice([None, -2.0, 1.0])) for _ in range(200)]
    got, _ = run(spark, rows)
    has = {"county": lambda v: v in ("X1", "x1", "Y"), "no": lambda v: v in (5, 6), "m": lambda v: v == 1.0}
    want = set()
    for k, (f, test) in enumerate(has.items()):
        known = {r[0] for r in rows if test(r[2 + k])}
        want |= {(i, f) for i, r in enumerate(rows) if not test(r[2 + k]) and r[0] in known}
    assert set(got) == want


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert I.fills(df, "id", "e", "t", SPECS).count() == 0
