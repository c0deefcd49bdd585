import pytest
from pyspark.sql import functions as F

from geolathe.functions.expressions import ExpressionError, Translator, assigned, parse

ROW = (3.0, None, "Abc Def", True, [1.0, 5.0], "2020-03-01", 0.0)


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([ROW], "n double, z double, s string, b boolean, a array<double>, d string, o double")


CASES = {
    "n + 1": 4.0, "z + 1": 1.0, "n + s": "3Abc Def", "n / o": float("inf"), "-n % 2": -1.0, "2 ** 3 ** 2": 512.0, "n > 2 && s == 'Abc Def'": True, "z == null": True, "z < 1": True, "n === '3'": False, "n == '3'": True,
    "n > 2 ? 'x' : 'y'": "x", "!s": False, "s.length": 7.0, "s.substr(1, 2)": "bc", "s.slice(-3)": "Def", "s.substring(4, 1)": "bc ", "s.indexOf('D')": 4.0, "s.includes('bc')": True, "s.toUpperCase()": "ABC DEF",
    "s.replace('b', 'X')": "AXc Def", "s.replace(/[a-z]/g, '')": "A D", "s.replace(/[a-z]/, '-')": "A-c Def", "s.split(' ')[1]": "Def", "/^A/.test(s)": True, "`v${n}`": "v3", "Math.max(n, 5)": 5.0, "Math.round(-2.5)": -2.0, "round(2.345, 2)": 2.35,
    "a[1]": 5.0, "a.map(x => x * 2).join('-')": "2-10", "a.some(x => x > 4)": True, "a.includes(1)": True, "parseInt('12px')": 12.0, "+'4'": 4.0, "n.toFixed(2)": "3.00", "'7'.padStart(3, '0')": "007", "sprintf('%+.2f|%05d|%s|%%', n, 42, s)": "+3.00|00042|Abc Def|%", "sprintf('%d', -5)": "−5",
    "parse_dms('12°30′0″S')": -12.5, "format_dms(12.5, \"[-]D°M′\")": "12°30′", "blend('#ff0000', 1, '#0000ff', 1)": "#800080", "b ? 1 : 0": 1.0, "typeof n": "number", "z ?? 7": 7.0, "n in [1, 3]": True, "(x => x)": None,
}


@pytest.mark.parametrize("text", [k for k in CASES if k != "(x => x)"])
def test_values(df, text):
    assert df.select(Translator.of(df.schema).column(text).col.alias("v")).first()["v"] == CASES[text]


def test_definitions_and_errors(df):
    t = Translator.of(df.schema, defs={"k": 2, "f": parse("(x, y) => x * y")[0]})
    assert df.select(t.column("f(n, k)").col).first()[0] == 6.0
    for bad in ("n +", "unknown + 1", "eval('1')", "n = ", "@"):
        with pytest.raises(ExpressionError):
            Translator.of(df.schema).column(bad)
    assert assigned("a = 1, d['b c'] = 2; this.properties.c = a") == ["a", "b c", "c"]


def test_predicates_reach_the_scan(spark, tmp_path):
    spark.range(10).select(F.col("id").cast("double").alias("v"), F.lit("x").alias("s")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = df.where(Translator.of(df.schema).column("s == 'x'").col).select("v")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [EqualNullSafe(s,x)]" in plan or "EqualNullSafe" in plan or "EqualTo(s,x)" in plan
