"""Filling missing values from other rows of the same entity, along time, with every filled cell marked.

The rows are first combined to one line per entity, field and time (partial aggregation before the shuffle) and the
lines are written once, so what the time-ordered step sees of an entity is the number of its distinct times, not of its
rows. That step is split further into blocks of time, so no task gets the whole of a hot entity. Only the missing cells
are then joined with the lines: the second and last scan of the rows, with hot keys, known from the lines, salted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geolathe.plans.skew import salted_join
from geolathe.session import written

# Texts that stand for no value, compared in lower case with the marks around them taken off.
STAND_INS = [
    "", "n a", "na", "nan", "null", "nil", "none", "blank", "empty", "missing", "unknown", "unk", "undefined",
    "unassigned", "unspecified", "undetermined", "not stated", "not known", "not available", "not applicable",
    "not assigned", "not given", "not specified", "not reported", "not recorded", "no data", "no value", "void",
    "tbd", "tba", "tbc", "to be determined", "pending", "x", "xx", "xxx", "xxxx",
]


@dataclass(frozen=True)
class Filled:
    """A column to fill.

    kind ``name``: text, blanks and case don't part values, and texts without a letter hold none;
    kind ``code``: an integer that names something, between low and high; neighbours are carried, never averaged;
    kind ``measure``: a number between low and high; between two observed neighbours it is interpolated in time.
    """

    name: str
    kind: str = "name"
    low: float | None = None
    high: float | None = None


def observed(column: Column, spec: Filled) -> Column:
    """The value as text in one spelling, or null where the cell holds none (null, blank, stand-in, out of range)."""
    if spec.kind == "name":
        text = F.regexp_replace(F.regexp_replace(column.cast("string"), r"(?U)\s+", " "), r"(?U)\A\s+|\s+\z", "")
        core = F.lower(F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")))
        return F.when(core.rlike(r"\p{L}") & ~core.isin(STAND_INS), text)
    number = column.try_cast("double")
    good = number.isNotNull() & ~F.isnan(number)
    if spec.low is not None:
        good &= number >= spec.low
    if spec.high is not None:
        good &= number <= spec.high
    return F.when(good, (number.cast("long") if spec.kind == "code" else number).cast("string"))


def cells(df: DataFrame, id_col: str, entity: str, time: str, specs: list[Filled]) -> DataFrame:
    """One row per cell of the filled columns: id, entity, time, field, value (text or null). Entities aren't null."""
    each = F.array(*[F.struct(F.lit(s.name).alias("field"), observed(F.col(s.name), s).alias("value")) for s in specs])
    return df.select(F.col(id_col).alias("_id"), F.col(entity).alias("_entity"), F.col(time).alias("_time"), F.explode(each).alias("c")).where(F.col("_entity").isNotNull()).select("_id", "_entity", "_time", "c.field", "c.value")


def lines(cell: DataFrame, specs: list[Filled]) -> DataFrame:
    """Per entity, field and time: the value most rows hold there (null if none does), and the rows that hold none.

    Spellings that differ only in case are counted together and given back in the spelling most used, mixed case
    before capitals; ties go to the smaller text, so the result doesn't depend on the order of rows.
    """
    measures = [s.name for s in specs if s.kind == "measure"]
    keyed = cell.withColumn("key", F.upper("value"))
    spelled = keyed.groupBy("_entity", "field", "_time", "key", "value").agg(F.count(F.lit(1)).alias("n"))
    by_key = spelled.groupBy("_entity", "field", "_time", "key").agg(
        F.sum("n").alias("n"),
        F.min_by("value", F.struct((F.col("value") == F.col("key")).cast("int"), -F.col("n"), F.col("value"))).alias("value"),
    )
    mean = F.sum(F.col("value").try_cast("double") * F.col("n")) / F.sum(F.when(F.col("value").isNotNull(), F.col("n")))
    return by_key.groupBy("_entity", "field", "_time").agg(
        F.min_by("value", F.struct(F.col("value").isNull().cast("int"), -F.col("n"), F.col("value"))).alias("_most"),
        mean.alias("_mean"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing"),
    ).select("_entity", "field", "_time", "missing", (F.when(F.col("field").isin(measures), F.col("_mean").cast("string")).otherwise(F.col("_most")) if measures else F.col("_most")).alias("value"))


def neighbours(line: DataFrame, block: str = "year") -> DataFrame:
    """Lines with missing cells, with the last observed (time, value) before and the first after their time.

    Two levels: within blocks of time (a partition holds one block of one entity), and over the blocks' first and
    last observations, of which there are as many as blocks. Rows without a time have no neighbours in time.
    """
    seen = F.when(F.col("value").isNotNull() & F.col("_time").isNotNull(), F.struct(F.col("_time").alias("t"), F.col("value").alias("v")))
    df = line.withColumn("_seen", seen).withColumn("_block", F.date_trunc(block, "_time"))
    own = Window.partitionBy("_entity", "field", "_block")
    before = own.orderBy(F.asc("_time")).rowsBetween(Window.unboundedPreceding, -1)
    after = own.orderBy(F.desc("_time")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = df.groupBy("_entity", "field", "_block").agg(F.max("_seen").alias("_last"), F.min("_seen").alias("_first"))
    over = Window.partitionBy("_entity", "field")
    blocks = blocks.select(
        "_entity", "field", "_block",
        F.last("_last", ignorenulls=True).over(over.orderBy(F.asc("_block")).rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"),
        F.last("_first", ignorenulls=True).over(over.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)).alias("_coming"),
    )
    inner = df.withColumn("_before", F.last("_seen", ignorenulls=True).over(before)).withColumn("_after", F.last("_seen", ignorenulls=True).over(after))
    same = [F.col("i." + c).eqNullSafe(F.col("b." + c)) for c in ("_entity", "field", "_block")]
    joined = inner.alias("i").join(blocks.alias("b"), same[0] & same[1] & same[2], "left")
    return joined.where(F.col("i.missing") > 0).select("i._entity", "i.field", "i._time", "i.value", F.coalesce("i._before", "b._carried").alias("prev"), F.coalesce("i._after", "b._coming").alias("next"))


def decided(near: DataFrame, specs: list[Filled], gap_days: float) -> DataFrame:
    """The fill for a missing cell of each entity, field and time, with method and distance in days.

    Methods, in this order: ``same_time`` (other rows of that time hold a value), ``interpolated`` (measure between
    two neighbours), ``agreed`` (both neighbours hold the same value), ``carried_forward`` / ``carried_back`` (the
    nearer neighbour, the earlier of two as near) and ``beyond_gap`` for the same beyond ``gap_days``: a last resort
    that is still filled, so that it is marked and can be dropped. Rows without a time take ``any_time``.
    """
    measures = [s.name for s in specs if s.kind == "measure"]
    days = lambda a, b: F.abs(F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / F.lit(86400e6)
    time, prev, nxt = F.col("_time"), F.col("prev"), F.col("next")
    dp, dn = days(time, prev.t), days(time, nxt.t)
    both = prev.isNotNull() & nxt.isNotNull()
    back = prev.isNull() | F.coalesce(dn < dp, F.lit(False))
    between = (prev.v.try_cast("double") * dn + nxt.v.try_cast("double") * dp) / (dp + dn)
    inter = both & F.col("field").isin(measures) & (F.least(dp, dn) <= gap_days) if measures else F.lit(False)
    agreed = both & (F.upper(prev.v) == F.upper(nxt.v))
    least = F.least(dp, dn)
    method = (
        F.when(F.col("value").isNotNull(), "same_time").when(inter, "interpolated").when(agreed & (least <= gap_days), "agreed")
        .when(least > gap_days, "beyond_gap").when(prev.isNull() & nxt.isNull(), F.lit(None)).when(back, "carried_back").otherwise("carried_forward")
    )
    fill = F.when(F.col("value").isNotNull(), F.col("value")).when(inter, between.cast("string")).when(agreed | ~back, F.coalesce(prev.v, nxt.v)).otherwise(nxt.v)
    return near.select("_entity", "field", "_time", fill.alias("fill"), method.alias("method"), F.when(F.col("value").isNotNull(), 0.0).otherwise(least).alias("distance_days"))


def fills(df: DataFrame, id_col: str, entity: str, time: str, specs: list[Filled], gap_days: float = 366.0, block: str = "year") -> DataFrame:
    """One row per filled cell: id, field, fill (text), method, distance_days.

    A cell is filled exactly if it holds no value and some row of its entity holds one in that column. Rows with a
    null entity belong to no group and are never filled; an empty table gives an empty result; repeated rows each
    get their cells filled.
    """
    cell = cells(df, id_col, entity, time, specs)
    line = written(lines(cell, specs), "lines")
    asked = decided(neighbours(line.where(F.col("_time").isNotNull()), block), specs, gap_days)
    undated = line.where(F.col("_time").isNull() & (F.col("missing") > 0)).select("_entity", "field", "_time", F.lit(None).cast("string").alias("fill"), F.lit(None).cast("string").alias("method"), F.lit(None).cast("double").alias("distance_days"))
    # cells without a time, and those whose entity only holds values in rows without one, take what most times show
    shown = line.where(F.col("value").isNotNull()).groupBy("_entity", "field", "value").agg(F.count(F.lit(1)).alias("n"))
    shown = shown.groupBy("_entity", "field").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("_shown"))
    answers = asked.unionByName(undated).join(shown, ["_entity", "field"])
    answers = answers.select(
        "_entity", "field", _instant(), F.coalesce("fill", "_shown").alias("fill"),
        F.when(F.col("fill").isNull(), "any_time").otherwise(F.col("method")).alias("method"), F.when(F.col("fill").isNotNull(), F.col("distance_days")).alias("distance_days"),
    )
    missing = cell.where(F.col("value").isNull()).select("_id", "_entity", "field", _instant())
    keys = ["_entity", "field", "_instant"]
    counts = line.where(F.col("missing") > 0).select("_entity", "field", _instant(), F.col("missing").alias("_n"))
    out = salted_join(missing, answers, keys, F.col("_id"), "inner", counts=counts)
    return out.select(F.col("_id").alias(id_col), "field", "fill", "method", "distance_days")


def _instant() -> Column:
    """The time as a number to join on; rows without one have one of their own."""
    return F.coalesce(F.unix_micros(F.col("_time").cast("timestamp")), F.lit(-(1 << 63))).alias("_instant")


def filled_table(df: DataFrame, id_col: str, entity: str, time: str, specs: list[Filled], **options: float) -> DataFrame:
    """``df`` with the filled columns in place, and ``<column>_method`` / ``<column>_days`` (null: as delivered).

    Cells that hold a stand-in and can't be filled become null. ``id_col`` must be unique.
    """
    fill = fills(df, id_col, entity, time, specs, **options)
    wide = fill.groupBy(id_col).agg(*[F.max(F.when(F.col("field") == s.name, F.struct("fill", "method", "distance_days"))).alias(f"_f_{s.name}") for s in specs])
    out = df.join(wide, id_col, "left")
    kinds = dict(df.dtypes)
    for s in specs:
        f = F.col(f"_f_{s.name}")
        value = F.when(observed(F.col(s.name), s).isNotNull(), F.col(s.name)).otherwise(f.fill.cast(kinds[s.name]))
        out = out.withColumns({s.name: value, f"{s.name}_method": f.method, f"{s.name}_days": f.distance_days})
    return out.drop(*[f"_f_{s.name}" for s in specs])
