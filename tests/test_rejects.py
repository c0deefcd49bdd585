import csv
import io

from hypothesis import given, settings
from hypothesis import strategies as st

from geolathe.operators import rejects as R

GOOD = "Feature,12,1234567890123456,12345,0,0.5,,99.5,Water,,1e3"


def reasons(spark, rows):
    df = spark.createDataFrame(list(enumerate(rows)), "row_id bigint, raw_row string")
    got = R.judged(df, "raw_row", R.block_fields()).select("row_id", "reasons").collect()
    return [r["reasons"] for r in sorted(got)]


def changed(i, value):
    parts = GOOD.split(",")
    parts[i] = value
    return ",".join(parts)


def test_reasons_by_kind(spark):
    rows = [
        GOOD, GOOD + "\r", changed(9, '"a, b"'), changed(9, '"a\nb"'), changed(9, '"say ""x"""'), changed(1, "1.0"), changed(1, " 1.20e1 "), changed(1, "12000e-3"),
        None, "", "a,b", changed(9, "a, b"), changed(9, 'x"y'), changed(9, '"open'), changed(9, "a\nb"), GOOD + "\r\r",
        changed(0, "feature"), changed(1, "0"), changed(1, "1.5"), changed(1, "2147483648"), changed(1, "1e40"), changed(1, "١"), changed(2, "123"), changed(4, "01"), changed(5, "inf"), changed(5, "1e999"), changed(7, "100.1"), changed(7, "-1"), changed(8, " "), changed(10, "1,5"),
    ]
    got = reasons(spark, rows)
    assert got[:8] == [[]] * 8
    assert got[8:16] == [["missing"], ["column_count"], ["column_count"], ["column_count"], ["quoting"], ["quoting"], ["quoting"], ["quoting"]]
    assert got[16:] == [["value:type"], *[["value:OBJECTID"]] * 5, ["value:PBG00"], ["value:WATER00"], ["value:HU2010ADJ"], ["value:HU2010ADJ"], ["value:VEG01PC"], ["value:VEG01PC"], ["value:WUICLASS"], ["column_count"]]


def test_loaded_types_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "x", changed(9, '"a ""b"", c"'))], "row_id bigint, NOTE string, raw_row string")
    r = R.loaded(df, "raw_row", R.block_fields()).first()
    assert (r["OBJECTID"], r["NOTE"], r["HU2010ADJ"], r["HDEN2010"], r["Shape_Area"]) == (12, 'a "b", c', 0.5, None, 1000.0)
    assert R.loaded(df.limit(0), "raw_row", R.block_fields()).count() == 0


def test_very_long_field(spark):
    long = changed(9, '"' + 'ab""' * 200_000 + '"')
    assert reasons(spark, [long, changed(9, '"' + "a" * 500_000)]) == [[], ["quoting"]]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.text(alphabet='ab," \n', max_size=5), min_size=11, max_size=11), min_size=1, max_size=20))
def test_what_a_csv_writer_writes_is_cut_into_its_fields(spark, rows):
    def line(r):
        s = io.StringIO()
        csv.writer(s, lineterminator="").writerow(r)
        return s.getvalue()

    df = spark.createDataFrame([(i, line(r)) for i, r in enumerate(rows)], "row_id bigint, raw_row string")
    got = R.judged(df, "raw_row", R.block_fields()).orderBy("row_id").collect()
    assert [g["_fields"] for g in got] == rows
