"""Aggregates of ``calc`` expressions: one partial and final aggregation, plus one small join per ``mode``."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolathe.functions.expressions import ARR, BOOL, NUM, ExpressionError, Translator, Value, parse, plain_number, truth, walk
from geolathe.layer import FID, GEOM, with_fid

NUMERIC = {"sum", "mean", "average", "median", "quartile1", "quartile2", "quartile3", "iqr", "quantile", "min", "max"}
NAMES = NUMERIC | {"count", "sums", "mode", "collect", "collectIds", "first", "last", "every", "some", "width", "height"}


@dataclass
class Plan:
    """What an expression needs: aggregate columns by name, and the columns whose mode is wanted."""

    aggs: dict[str, Column] = field(default_factory=dict)
    modes: dict[str, Column] = field(default_factory=dict)
    sums: dict[str, Column] = field(default_factory=dict)
    #: quantiles: the value and the share
    quantiles: dict[str, tuple[Column, float]] = field(default_factory=dict)

    def add(self, column: Column, kind: str, item: str = NUM) -> Value:
        name = f"_a{len(self.aggs)}"
        self.aggs[name] = column
        return Value(F.col(name), kind, item)


def functions(plan: Plan, rows: Translator, point: bool | None = None, skip_nulls: bool = False) -> dict:
    """The aggregate functions, as calls of a translator whose results refer to the plan's columns.

    Numbers: NaN is left out; null counts as 0 in mean and quantiles unless ``skip_nulls``; sums skip it anyway.
    Over no rows count and sum are 0, every and some false, the others null.
    """
    fid = F.col(FID)

    def arg(args: list) -> Value:
        if not args:
            raise ExpressionError("an aggregate needs a value")
        return rows.value(args[0])

    def num(args: list) -> Column:
        v = arg(args)
        if v.kind == BOOL:
            return v.col.cast("double")
        x = plain_number(v)
        return F.when(~F.isnan(x), x)

    def zeroed(args: list) -> Column:
        x = num(args)
        if skip_nulls:
            return x
        v = rows.value(args[0])
        return F.when(v.col.isNull(), F.lit(0.0)).otherwise(x)

    def ranked(args: list, p: float) -> Value:
        name = f"_q{len(plan.quantiles)}"
        plan.quantiles[name] = (zeroed(args), p)
        return Value(F.col(name), NUM)

    def quantile(p: float):  # noqa: ANN202
        return lambda args, _: ranked(args, p)

    def by_order(pick, args: list) -> Value:  # noqa: ANN001
        v = arg(args)
        return plan.add(pick(F.struct(v.col.alias("v")), fid).getField("v"), v.kind, v.item)

    def mode(args: list, _: Translator) -> Value:
        v = arg(args)
        name = f"_m{len(plan.modes)}"
        plan.modes[name] = v.col
        return Value(F.col(name), v.kind, v.item)

    def sums(args: list, _: Translator) -> Value:
        name = f"_s{len(plan.sums)}"
        plan.sums[name] = arg(args).col
        return Value(F.col(name), ARR, NUM)

    def collect(args: list, _: Translator) -> Value:
        v = arg(args)
        pairs = F.array_sort(F.collect_list(F.struct(fid.alias("i"), v.col.alias("v"))))
        got = F.transform(pairs, lambda z: z["v"])
        return plan.add(F.when(F.size(got) > 0, got), ARR, v.kind)

    def extent(axis: int):  # noqa: ANN202
        def run(args: list, _: Translator) -> Value:
            if point is None:
                raise ExpressionError("width() and height() need geometry")
            flat = F.col(GEOM) if point else F.flatten(F.col(GEOM))
            values = F.transform(flat, lambda p: p[axis])
            return plan.add(F.max(F.array_max(values)) - F.min(F.array_min(values)), NUM)

        return run

    def iqr(args: list, _: Translator) -> Value:
        both = [ranked(args, p).col for p in (0.75, 0.25)]
        return Value(both[0] - both[1], NUM)

    def q(args: list, _: Translator) -> Value:
        if len(args) < 2 or args[1][0] != "num":
            raise ExpressionError("quantile() needs a constant share")
        return ranked(args[:1], float(args[1][1]))

    return {
        "count": lambda args, _: plan.add(F.count(F.lit(1)).cast("double"), NUM),
        "sum": lambda args, _: plan.add(F.coalesce(F.sum(num(args)), F.lit(0.0)), NUM),
        "mean": lambda args, _: plan.add(F.avg(zeroed(args)), NUM),
        "average": lambda args, _: plan.add(F.avg(zeroed(args)), NUM),
        "median": quantile(0.5), "quartile1": quantile(0.25), "quartile2": quantile(0.5), "quartile3": quantile(0.75),
        "iqr": iqr, "quantile": q, "mode": mode, "sums": sums, "collect": collect,
        "min": lambda args, _: plan.add(F.min(num(args)), NUM),
        "max": lambda args, _: plan.add(F.max(num(args)), NUM),
        "collectIds": lambda args, _: plan.add(F.array_sort(F.collect_list(fid)), ARR, NUM),
        "first": lambda args, _: by_order(F.min_by, args),
        "last": lambda args, _: by_order(F.max_by, args),
        "every": lambda args, _: plan.add(F.coalesce(F.bool_and(truth(arg(args))), F.lit(False)), BOOL),
        "some": lambda args, _: plan.add(F.coalesce(F.bool_or(truth(arg(args))), F.lit(False)), BOOL),
        "width": extent(0), "height": extent(1),
    }


def compiled(calc: str, rows: Translator, **options: object) -> tuple[Plan, list[tuple[str, Value]]]:
    """The plan of a calc expression and its outputs (name, value over the plan's columns).

    An output without an assignment is named after its text. Aggregates may be combined freely, but they can't stand
    inside a condition.
    """
    plan = Plan()
    # min() and max() of several values are not aggregates, so names are looked up in order
    outer = Translator({}, rows.this, rows.defs, functions(plan, rows, **options), unknown_null=False)  # type: ignore[arg-type]
    outputs: list[tuple[str, Value]] = []
    for node, source in zip(parse(calc), sources(calc)):
        if any(x[0] in ("if",) and any(c[0] == "call" and c[1][0] == "name" and c[1][1] in NAMES for c in walk(x[2:])) for x in walk(node)):
            raise ExpressionError("an aggregate can't stand inside a condition")
        name, value = (node[1][1] if node[1][0] == "name" else node[1][2], node[2]) if node[0] == "assign" else (source, node)
        result = outer.value(value)
        outputs.append((name, result))
        outer.fields[name] = result
    return plan, outputs


def sources(calc: str) -> list[str]:
    """The texts of the statements."""
    out, depth, begin = [], 0, 0
    for i, c in enumerate(calc):
        depth += (c in "([{") - (c in ")]}")
        if c in ",;" and depth == 0:
            out.append(calc[begin:i].strip())
            begin = i + 1
    return [s for s in [*out, calc[begin:].strip()] if s]


def grouped(df: DataFrame, keys: list[str], plan: Plan, extra: dict[str, Column] | None = None) -> DataFrame:
    """Keys, the plan's columns and ``extra`` aggregates per group; without keys one row, even of no rows.

    Null keys form a group. A mode is counted per value first and then picked, ties by first appearance, so no group
    is ever gathered in a task; it's joined by null-safe keys.
    """
    by_rank = bool(plan.quantiles) and _large_groups(df, keys)
    own = {} if by_rank else {n: F.percentile(c, F.lit(p)) for n, (c, p) in plan.quantiles.items()}
    aggs = [c.alias(n) for n, c in {**plan.aggs, **own, **(extra or {})}.items()] or [F.count(F.lit(1)).alias("_n")]
    out = df.groupBy(*keys).agg(*aggs)
    side: list[tuple[list[str], DataFrame]] = []
    if by_rank:
        side += _ranked_quantiles(df, keys, plan)
    for name, value in plan.modes.items():
        valued = df.select(*keys, FID, value.alias("_v")).groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"), F.min(FID).alias("_first"))
        side.append(([name], valued.groupBy(*keys).agg(F.min_by(F.struct("_v"), F.struct(-F.col("_n"), F.col("_first"))).getField("_v").alias(name))))
    for name, value in plan.sums.items():
        first = F.size(F.min_by(value, F.col(FID)))
        widths = df.groupBy(*keys).agg(first.alias("_w"))
        parts = df.select(*keys, F.posexplode(value).alias("_i", "_x")).groupBy(*keys, "_i").agg(F.sum(F.col("_x").cast("double")).alias("_x"))
        listed = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "_x"))).alias("_l"))
        if not keys:
            width = widths.first()["_w"]
            side.append(([name], listed.select(F.slice(F.transform("_l", lambda z: z["_x"]), 1, max(0, width or 0)).alias(name))))
            continue
        joined = null_safe(widths, listed, keys)
        side.append(([name], joined.select(*keys, F.slice(F.transform("_l", lambda z: z["_x"]), F.lit(1), F.col("_w")).alias(name))))
    for names, table in side:
        if keys:
            out = null_safe(out, table, keys)
        else:  # one row: its value
            row = table.first()
            out = out.withColumns({n: F.lit(row[n] if row else None).cast(table.schema[n].dataType) for n in names})
    return out


#: Rows of a group beyond which its quantiles are found by rank: an aggregate would hold its distinct values in one task.
LARGE_GROUP = 2_000_000


def _large_groups(df: DataFrame, keys: list[str]) -> bool:
    if not keys:
        return df.limit(LARGE_GROUP + 1).count() > LARGE_GROUP
    return not df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > LARGE_GROUP).isEmpty()


def _ranked_quantiles(df: DataFrame, keys: list[str], plan: Plan) -> list[tuple[list[str], DataFrame]]:
    """Exact quantiles by rank: a distributed sort by group and value, then only the two rows around each rank."""
    by_value: dict[str, tuple[Column, list[tuple[str, float]]]] = {}
    for n, (c, p) in plan.quantiles.items():
        by_value.setdefault(str(c), (c, []))[1].append((n, p))
    side = []
    for value, wanted in by_value.values():
        rows = df.select(*keys, value.alias("_v")).where(F.col("_v").isNotNull())
        sorted_ = with_fid(rows.orderBy(*keys, "_v"), shuffled=True).withColumnRenamed(FID, "_rank")
        ends = sorted_.groupBy(*keys).agg(F.min("_rank").alias("_from"), F.count(F.lit(1)).alias("_n"))
        place = lambda p: F.lit(p) * (F.col("_n") - 1)
        asked = F.array(*[F.struct(F.lit(n).alias("q"), (F.col("_from") + f(place(p))).cast("long").alias("_rank"), w.alias("w")) for n, p in wanted for f, w in ((F.floor, F.floor(place(p)) + 1 - place(p)), (F.ceil, place(p) - F.ceil(place(p)) + F.when(F.floor(place(p)) == place(p), 0.0).otherwise(1.0)))])
        points = ends.select(F.explode(asked).alias("a")).select("a.q", "a._rank", "a.w")
        got = sorted_.join(points, "_rank").groupBy(*keys).agg(*[F.sum(F.when(F.col("q") == n, F.col("_v") * F.col("w"))).alias(n) for n, _ in wanted])
        side.append(([n for n, _ in wanted], got))
    return side


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join on keys of the same names where null meets null; the left keys are kept."""
    renamed = right.select(*[F.col(f"`{k}`").alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [F.col(f"`{k}`").eqNullSafe(F.col(f"`_r_{k}`")) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])
