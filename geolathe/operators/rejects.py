"""Loading delimited text rows into types, with the rows that can't be loaded set apart and the reasons named.

Every field is first taken as nullable text; column expressions then test structure, casts and constraints and put
what they find wrong into an array of reasons. A row loads exactly if that array is empty. All of it is built-in
column arithmetic inside one stage: no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# One field of a row, behind its comma: quoted (quotes inside doubled), or free of quotes, commas and line breaks.
# The quantifiers are possessive: matching is linear and doesn't recurse, however long a field is.
FIELD = r',("[^"]*+(?:""[^"]*+)*+"|[^",\r\n]*+)'
ROW = rf"\A(?:{FIELD})++\z"
NUMBER = r"\A[ \t]*+[+-]?(?:[0-9]++(?:\.[0-9]*+)?|\.[0-9]++)(?:[eE][+-]?[0-9]++)?[ \t]*+\z"


@dataclass(frozen=True)
class Field:
    """A column of the target: its type and the test that a text must pass to be loaded (null: not loadable)."""

    name: str
    type: str
    valid: Callable[[Column], Column]
    convert: Callable[[Column], Column] | None = None


def is_number(text: Column) -> Column:
    """An ASCII decimal number, exponent allowed, blanks around allowed, finite as a double."""
    return text.rlike(NUMBER) & (F.abs(F.trim(text).try_cast("double")) < F.lit(float("inf")))


def is_whole(text: Column, low: int, high: int) -> Column:
    """A number without a fractional part between low and high, in plain, ``.0`` or exponent form.

    Decided on the digits, not on the rounded double: the digits after the point that remain once trailing zeros
    are gone must all be taken up by the exponent.
    """
    fraction = F.regexp_replace(F.regexp_extract(text, r"\.([0-9]*)", 1), "0+$", "")
    exponent = F.coalesce(F.regexp_extract(text, r"[eE]([+-]?[0-9]+)", 1).try_cast("int"), F.lit(0))
    tail = F.length(F.regexp_extract(F.regexp_extract(text, r"\A[ \t]*[+-]?([0-9]+)", 1), "(0*)$", 1))
    whole = F.when(F.length(fraction) > 0, F.length(fraction) <= exponent).otherwise(-exponent <= tail)
    return is_number(text) & whole & F.trim(text).try_cast("double").between(low, high)


def number_or_empty(text: Column) -> Column:
    return (text == "") | is_number(text)


def to_double(text: Column) -> Column:
    return F.trim(text).try_cast("double")


def once(c: Column) -> Column:
    """The column, computed once per row: a filter on it isn't pushed below and spelled out again for every use."""
    return F.when(F.monotonically_increasing_id() >= 0, c)


def judged(rows: DataFrame, raw: str, fields: list[Field]) -> DataFrame:
    """``rows`` with ``_fields`` (array of texts, null if the row can't be cut into fields) and ``reasons``.

    ``reasons`` is an array of ``code`` or ``code:column`` texts: ``missing`` (null row), ``quoting``,
    ``column_count`` or ``value:<column>``; it is empty exactly for rows that load. An empty text is a row of one
    empty field, hence a ``column_count`` case unless one column is expected. Each row is judged alone, so
    repeated rows get equal results; other columns of ``rows`` are carried along untouched.
    """
    text = F.regexp_replace(F.col(raw), r"\r\z", "")
    led = F.concat(F.lit(","), text)
    cut = F.regexp_extract_all(led, F.lit(FIELD), F.lit(1))
    plain = F.transform(cut, lambda f: F.when(f.startswith('"'), F.replace(f.substr(F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f))
    df = rows.withColumn("_ok", once(led.rlike(ROW))).withColumn("_fields", once(F.when(F.col("_ok"), plain)))
    at = [F.get(F.col("_fields"), F.lit(i)) for i in range(len(fields))]
    values = F.array_compact(F.array(*[F.when(~F.coalesce(f.valid(a), F.lit(False)), F.lit(f"value:{f.name}")) for f, a in zip(fields, at)]))
    reasons = (
        F.when(F.col(raw).isNull(), F.array(F.lit("missing")))
        .when(~F.col("_ok"), F.array(F.lit("quoting")))
        .when(F.size("_fields") != len(fields), F.array(F.lit("column_count")))
        .otherwise(values)
    )
    return df.withColumn("reasons", once(reasons)).drop("_ok")


def rejects(rows: DataFrame, raw: str, fields: list[Field]) -> DataFrame:
    """The rows that don't load, with ``reasons``."""
    return judged(rows, raw, fields).where(F.size("reasons") > 0).drop("_fields")


def loaded(rows: DataFrame, raw: str, fields: list[Field]) -> DataFrame:
    """The rows that load, cut into typed columns; a name that ``rows`` also has keeps the loaded value."""
    names = {f.name for f in fields}
    good = judged(rows, raw, fields).where(F.size("reasons") == 0)
    keep = [F.col(c) for c in rows.columns if c != raw and c not in names]
    typed = [(f.convert(a) if f.convert else a.try_cast(f.type)).alias(f.name) for i, f in enumerate(fields) for a in [F.get(F.col("_fields"), F.lit(i))]]
    return good.select(*keep, *typed)


def block_fields() -> list[Field]:
    """The columns of the housing-block rows and what each must hold."""
    digits = lambda n: lambda t: t.rlike(rf"\A[0-9]{{{n}}}\z")
    measure = lambda name: Field(name, "double", number_or_empty, to_double)
    percent = lambda t: (t == "") | (is_number(t) & to_double(t).between(0, 100))
    return [
        Field("type", "string", lambda t: t == "Feature"),
        Field("OBJECTID", "int", lambda t: is_whole(t, 1, 2147483647), lambda t: to_double(t).cast("int")),
        Field("PBG00", "string", digits(16)),
        Field("FIPS_PBG", "string", digits(5)),
        Field("WATER00", "int", lambda t: t.isin("0", "1")),
        measure("HU2010ADJ"),
        measure("HDEN2010"),
        Field("VEG01PC", "double", percent, to_double),
        Field("WUICLASS", "string", lambda t: F.regexp_replace(t, r"(?U)\s+", "") != ""),
        Field("NOTE", "string", lambda t: t.isNotNull()),
        measure("Shape_Area"),
    ]
