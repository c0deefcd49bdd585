"""Classification of a field: breaks from one or two aggregation passes, then a plain column expression per row."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolathe.functions.expressions import NUM, blend, text
from geolathe.layer import FID, Layer, LayerError, with_fid
from geolathe.operators.table import translator
from geolathe.plans.skew import salted_join
from geolathe.session import written

# Sequential colour ramps by their common names, light to dark.
SCHEMES = {
    "blues": ["#f7fbff", "#deebf7", "#c6dbef", "#9ecae1", "#6baed6", "#4292c6", "#2171b5", "#08519c", "#08306b"],
    "greens": ["#f7fcf5", "#e5f5e0", "#c7e9c0", "#a1d99b", "#74c476", "#41ab5d", "#238b45", "#006d2c", "#00441b"],
    "reds": ["#fff5f0", "#fee0d2", "#fcbba1", "#fc9272", "#fb6a4a", "#ef3b2c", "#cb181d", "#a50f15", "#67000d"],
    "greys": ["#ffffff", "#f0f0f0", "#d9d9d9", "#bdbdbd", "#969696", "#737373", "#525252", "#252525", "#000000"],
    "category10": ["#1f77b4", "#ff7f0e", "#2ca02c", "#d62728", "#9467bd", "#8c564b", "#e377c2", "#7f7f7f", "#bcbd22", "#17becf"],
}


def values(layer: Layer, name: str) -> DataFrame:
    """The numbers of a field as ``v``: null and NaN left out."""
    layer.need(name)
    v = F.col(f"`{name}`").cast("double")
    return layer.df.select(v.alias("v")).where(v.isNotNull() & ~F.isnan(v))


#: Shares of all values around a rank within which it's looked for, and the accuracy that makes sure of it.
AROUND, ACCURACY = 2e-4, 20_000


def ranked_values(vals: DataFrame, ranks: list[int], n: int | None = None) -> list[float]:
    """The values at some ranks (from 0) of the sorted values, exactly.

    Approximate quantiles give a bracket around each rank; the values below each are counted, and only those within,
    a few ten-thousandths of all, are sorted.
    """
    if not ranks:
        return []
    n = vals.count() if n is None else n
    wanted = sorted(set(ranks))
    shares = [min(1.0, max(0.0, r / n + d)) for r in wanted for d in (-AROUND, AROUND)]
    at = vals.agg(F.percentile_approx("v", shares, ACCURACY)).first()[0]
    low, high = vals.agg(F.min("v"), F.max("v")).first()
    brackets = [(low if shares[2 * k] == 0 else at[2 * k], high if shares[2 * k + 1] == 1 else at[2 * k + 1]) for k in range(len(wanted))]
    held = F.filter(F.array(*[F.when(F.col("v").between(a, b), F.lit(k)) for k, (a, b) in enumerate(brackets)]), lambda k: k.isNotNull())
    below = vals.agg(*[F.count(F.when(F.col("v") < a, 1)).alias(f"b{k}") for k, (a, _) in enumerate(brackets)]).first()
    rows = with_fid(vals.select(F.explode(held).alias("k"), "v").orderBy("k", "v"), shuffled=True)
    start = {r["k"]: r["a"] for r in rows.groupBy("k").agg(F.min(FID).alias("a")).collect()}
    places = {start[k] + r - below[f"b{k}"]: r for k, r in enumerate(wanted)}
    got = {places[r[FID]]: r["v"] for r in rows.where(F.col(FID).isin(sorted(places))).collect()}
    return [got[r] for r in ranks]


def quantile_breaks(vals: DataFrame, classes: int) -> list[float]:
    """Class bounds at ``sorted[floor(i n / k)]``: values of the data, nothing interpolated."""
    n = vals.count()
    return ranked_values(vals, [i * n // classes for i in range(1, classes)], n) if n else []


def equal_breaks(low: float, high: float, classes: int) -> list[float]:
    return [low + (high - low) * i / classes for i in range(1, classes)]


def hybrid_breaks(vals: DataFrame, classes: int) -> list[float]:
    """The outer classes hold their quantile share; the inner ones are equal intervals of the range between."""
    outer = quantile_breaks(vals, classes)
    if classes < 4 or len(outer) < 2:
        return outer
    low, high = outer[0], outer[-1]
    inner = vals.where((F.col("v") >= low) & (F.col("v") < high)).agg(F.min("v"), F.max("v")).first()
    a, b = (low, high) if inner[0] is None else (inner[0], inner[1])
    return [low, *[a + (b - a) * i / (classes - 2) for i in range(1, classes - 2)], high]


# Round steps between 10 and 100, each with the unit that its first bound is rounded to.
NICE_STEPS = {10: 10, 12: 2, 15: 5, 18: 2, 20: 10, 22: 2, 25: 5, 30: 10, 35: 5, 40: 10, 45: 5, 50: 50, 60: 10, 70: 10, 80: 10, 90: 10, 100: 10}


def nice_candidates(low: float, high: float, breaks: int) -> list[tuple[float, list[float]]]:
    """(roundness, bounds) for the two round steps around the mean distance of bounds that run from ``low`` to ``high``.

    The first bound is one of the two multiples of the step's unit next to ``low``.
    """
    span = (high - low) / (breaks - 1) if breaks > 1 else max(abs(low), abs(high))
    if not 1e-4 < span < 1e9:
        raise LayerError("the range of the values is too small or too large for nice breaks")
    power = 0
    while span > 100 or span < 10:
        span, power = (span / 10, power + 1) if span > 100 else (span * 10, power - 1)
    scaled = (lambda v: v * 10**power) if power >= 0 else (lambda v: v / 10**-power)
    steps = list(NICE_STEPS)
    at = next(k for k in range(1, len(steps)) if steps[k - 1] <= span <= steps[k])
    out = []
    for step in steps[at - 1 : at + 1]:
        unit = NICE_STEPS[step]
        weight = 1.0 if unit >= 50 else 0.9 if unit >= 10 else 0.8 if unit >= 5 else 0.7
        per = round(1 / scaled(unit)) if scaled(unit) < 1 else 1 / scaled(unit)
        near = math.floor(low * per + 0.5) / per
        for first in sorted((near, near + (scaled(unit) if low > near else -scaled(unit)))):
            out.append((weight, [first + scaled(step) * i for i in range(breaks)]))
    return out


def nice_breaks(vals: DataFrame, classes: int) -> list[float]:
    """Equally spaced round bounds near the quantiles at the ends: the candidate with the best product of roundness and
    balance, which is how near the first and last class come to an equal share. One pass counts all candidates."""
    ends = quantile_breaks(vals, classes)
    if not ends:
        return []
    found = nice_candidates(ends[0], ends[-1], classes - 1)
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, (_, b) in enumerate(found):
        aggs += [F.count(F.when(F.col("v") < b[0], 1)).alias(f"a{i}"), F.count(F.when(F.col("v") >= b[-1], 1)).alias(f"b{i}")]
    r = vals.agg(*aggs).first()
    ideal = r["n"] / classes
    share = lambda k: ideal / k if k > ideal else ideal / (2 * ideal - k)
    quality = [w * (share(r[f"a{i}"]) + share(r[f"b{i}"])) / 2 for i, (w, _) in enumerate(found)]
    return found[max(range(len(found)), key=lambda i: (quality[i], -i))][1]


@dataclass
class Classifier:
    """Bounds or categories, and the output of each class."""

    breaks: list[float] = field(default_factory=list)
    categories: list[str] | None = None
    outputs: list | None = None
    null_value: object = -1
    other: object = None
    indexed: bool = False
    continuous: bool = False
    outer: tuple[float, float] | None = None
    precision: float | None = None
    invert: bool = False
    #: (v, i): categories that aren't given but taken from the data, any number of them
    numbered: DataFrame | None = None

    @property
    def classes(self) -> int:
        return len(self.outputs) if self.outputs else len(self.categories) if self.categories else len(self.breaks) + 1

    def class_id(self, x: Column) -> Column:
        """The number of bounds not above x; -1 for null and NaN."""
        x = x.cast("double")
        if self.precision:
            x = F.floor(x / self.precision + 0.5).cast("double") * self.precision
        n = F.lit(0)
        for b in self.breaks:
            n = n + F.when(x >= F.lit(float(b)), 1).otherwise(0)
        top = len(self.breaks)
        return F.when(x.isNull() | F.isnan(x), F.lit(-1)).otherwise((F.lit(top) - n) if self.invert else n)

    def position(self, x: Column, low: float, high: float) -> Column:
        """Continuous class: the class number plus how far x is through its class."""
        x = F.least(F.lit(high), F.greatest(F.lit(low), x.cast("double")))
        edges = [low, *self.breaks, high]
        out = F.lit(float(len(edges) - 2))
        for i in range(len(edges) - 2, -1, -1):
            a, b = edges[i], edges[i + 1]
            through = F.lit(0.5) if a == b else (x - a) / (b - a)
            out = F.when(x < edges[i + 1], F.lit(float(i)) + through).otherwise(out) if i < len(edges) - 2 else (F.lit(float(i)) + through)
        # outputs sit at the ends of the range: classes - 1 steps from the first to the last
        k = len(edges) - 1
        return out * (k - 1) / k if k > 1 else F.lit(0.0)

    def column(self, x: Column, low: float = 0.0, high: float = 1.0, shown: Column | None = None) -> Column:
        """The output for a value; ``shown`` is the value as text, where that isn't its plain cast."""
        null = F.lit(self.null_value)
        if self.categories is not None:
            outs = self.outputs or list(range(len(self.categories)))
            out = F.lit(self.other if self.other is not None else self.null_value)
            label = x.cast("string") if shown is None else shown
            for c, o in reversed(list(zip(self.categories, outs))):
                out = F.when(label == c, F.lit(o)).otherwise(out)
            return F.when(x.isNull() | (label == ""), null).otherwise(out)
        if self.continuous and self.outputs:
            at = self.position(x, *(self.outer or (low, high)))
            out = None
            if self.invert:
                at = F.lit(float(len(self.outputs) - 1)) - at
            for i in range(len(self.outputs) - 1):
                a, b = self.outputs[i], self.outputs[i + 1]
                t = at - i
                part = blend([(F.lit(a), 1 - t), (F.lit(b), t)]) if isinstance(a, str) else F.lit(float(a)) + (F.lit(float(b)) - float(a)) * t
                out = part if out is None else F.when(at >= i, part).otherwise(out)
            v = x.cast("double")
            return F.when(v.isNull() | F.isnan(v), null).otherwise(out if out is not None else F.lit(self.outputs[0]))
        ids = x.cast("int") if self.indexed else self.class_id(x)
        if self.outputs is None:
            return F.when(ids.isNull(), F.lit(-1)).otherwise(ids)
        got = F.get(F.array(*[F.lit(o) for o in self.outputs]), ids)
        return F.when(ids.isNull() | (ids < 0), null).otherwise(F.coalesce(got, null))


def ramp(colours: list[str], n: int) -> list[str]:
    """``n`` colours spread over a ramp, mixed between its stops."""
    if n == len(colours):
        return colours
    parse = lambda c: [int(c[i : i + 2], 16) for i in (1, 3, 5)]
    out = []
    for i in range(n):
        at = i * (len(colours) - 1) / max(1, n - 1)
        j = min(int(at), len(colours) - 2) if len(colours) > 1 else 0
        a, b = parse(colours[j]), parse(colours[min(j + 1, len(colours) - 1)])
        out.append("#" + "".join(f"{round(p + (q - p) * (at - j)):02x}" for p, q in zip(a, b)))
    return out


def method_of(options: dict, kind: str) -> str:
    """The method that the options ask for; without one, categories for texts and quantiles for numbers."""
    for m in ("quantile", "equal-interval", "hybrid", "nice", "non-adjacent"):
        if options.get(m):
            return m
    if options.get("method"):
        return options["method"]
    if options.get("breaks"):
        return "breaks"
    if options.get("categories"):
        return "categorical"
    if options.get("index-field"):
        return "indexed"
    return "quantile" if kind == NUM else "categorical"


def numbered(layer: Layer, name: str) -> DataFrame:
    """(v, i): every value of a field as text, numbered from 0 in the order of first rows."""
    shown = text(translator(layer).fields[name], "")
    firsts = layer.df.where(shown != "").groupBy(shown.alias("v")).agg(F.min(FID).alias("_first"))
    return with_fid(firsts.orderBy("_first").select("v"), shuffled=True).select("v", F.col(FID).cast("int").alias("i"))


def classifier(layer: Layer, name: str, options: dict) -> Classifier:
    """A classifier from options named as in the command (classes, breaks, colors, values, stops, categories, ...)."""
    layer.need(name)
    kind = translator(layer).fields[name].kind
    method = method_of(options, kind)
    colours = options.get("colors")
    if options.get("color-scheme"):
        colours = SCHEMES[options["color-scheme"].lower()]
    if isinstance(colours, list) and len(colours) == 1 and colours[0].lower() in SCHEMES:
        colours = SCHEMES[colours[0].lower()]
    outputs = options.get("values") or colours
    classes = options.get("classes") or (len(options["breaks"]) + 1 if options.get("breaks") else len(options["categories"]) if options.get("categories") else len(outputs) if outputs else 4)
    c = Classifier(continuous=bool(options.get("continuous")), precision=options.get("precision"), invert=bool(options.get("invert")), other=options.get("other"))
    c.null_value = options["null-value"] if "null-value" in options else "#eee" if colours else (None if outputs else -1)
    if options.get("outer-breaks"):
        c.outer = tuple(sorted(float(v) for v in options["outer-breaks"]))  # type: ignore[assignment]
    if method == "categorical":
        cats = options.get("categories")
        if not cats or "*" in cats:
            c.numbered = numbered(layer, name)
            c.outputs = outputs or None
            return c
        c.categories = [str(x) for x in cats]
        if outputs:
            c.outputs = [outputs[i % len(outputs)] for i in range(len(c.categories))]
        return c
    if method == "indexed":
        c.indexed, c.outputs = True, outputs
        return c
    vals = values(layer, name)
    if c.precision:
        vals = vals.select((F.floor(F.col("v") / c.precision + 0.5).cast("double") * c.precision).alias("v"))
    if c.outer:
        vals = vals.select(F.least(F.lit(c.outer[1]), F.greatest(F.lit(c.outer[0]), F.col("v"))).alias("v"))
    if c.continuous and outputs and not options.get("breaks"):
        classes = max(1, len(outputs))
    if method == "breaks":
        given = [float(v) for v in options["breaks"]]
        if given != sorted(given):
            if given != sorted(given, reverse=True):
                raise LayerError("breaks must be in order")
            c.invert = not c.invert
        c.breaks = sorted(given)
    elif method == "equal-interval":
        low, high = c.outer or vals.agg(F.min("v"), F.max("v")).first()
        c.breaks = equal_breaks(low, high, classes) if low is not None else []
    elif method == "hybrid":
        c.breaks = hybrid_breaks(vals, classes)
    elif method == "nice":
        c.breaks = nice_breaks(vals, classes)
    elif method == "quantile":
        c.breaks = quantile_breaks(vals, classes)
    else:
        raise LayerError(f"unknown method {method}")
    if outputs:
        n = len(c.breaks) + 1
        c.outputs = outputs if c.continuous or len(outputs) == n else ramp(outputs, n) if colours else outputs
    return c


def classify(layer: Layer, name: str, save_as: str | None = None, **options: object) -> Layer:
    """Writes the class, or its colour or value, of each row's field to ``class``, ``fill`` or ``save_as``."""
    opts = {k.replace("_", "-"): v for k, v in options.items()}
    c = classifier(layer, name, opts)
    target = save_as or ("fill" if c.outputs and isinstance(c.outputs[0], str) and str(c.outputs[0]).startswith("#") else "class")
    low, high = (0.0, 1.0)
    if c.continuous and not c.outer:
        r = values(layer, name).agg(F.min("v"), F.max("v")).first()
        low, high = (float(r[0]), float(r[1])) if r[0] is not None else (0.0, 1.0)
    shown = text(translator(layer).fields[name], "")
    if c.numbered is not None:
        i = F.col("_class")
        got = F.get(F.array(*[F.lit(o) for o in c.outputs]), F.pmod(i, F.lit(len(c.outputs)))) if c.outputs else i
        joined = salted_join(layer.df.withColumn("_shown", shown), c.numbered.select(F.col("v").alias("_shown"), F.col("i").alias("_class")), ["_shown"], F.col(FID))
        return layer.with_df(joined.withColumn(target, F.when(i.isNull(), F.lit(c.null_value)).otherwise(got)).drop("_shown", "_class"))
    return layer.with_df(layer.df.withColumn(target, c.column(F.col(f"`{name}`"), low, high, shown)))


def colorizer(options: dict):  # noqa: ANN201
    """A function from a column to colours: breaks, categories or a stable hash of the value (``random``)."""
    colours = options["colors"]
    nodata = options.get("nodata", "white")
    if options.get("breaks"):
        c = Classifier(breaks=[float(b) for b in options["breaks"]], outputs=colours, null_value=nodata, precision=options.get("precision"))
        return c.column
    if options.get("random"):
        return lambda x: F.when(x.isNull(), F.lit(nodata)).otherwise(F.get(F.array(*[F.lit(v) for v in colours]), F.pmod(text_hash(x.cast("string")), F.lit(len(colours))).cast("int")))
    cats = options.get("categories") or []
    c = Classifier(categories=[str(v) for v in cats], outputs=colours, null_value=nodata, other=options.get("other", nodata))
    return c.column


def text_hash(text: Column) -> Column:
    """A multiplicative exclusive-or hash of the characters, 32 bits unsigned."""
    codes = F.transform(F.split(text, ""), lambda ch: F.ascii(ch).cast("long"))
    mixed = F.aggregate(codes, F.lit(5381).cast("long"), lambda h, c: F.pmod(h * 33, F.lit(1 << 32)).bitwiseXOR(c))
    return mixed


def components(df: DataFrame, id_col: str, members: str) -> DataFrame:
    """(id, component) of rows that share members of an array, directly or through others: the smallest id reached.

    Each round every row takes the least label among the rows it shares a member with, every label takes the least
    that any of its rows reached, and labels are followed one step further: components at least halve, so rounds
    grow with the logarithm of the rows. A round is written to the shared folder; joins on hot labels are salted.
    Rows without members stand alone; null ids are left out.
    """
    links = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.explode_outer(F.array_distinct(F.col(members))).alias("m"))
    links = written(links, "links")
    labels = links.groupBy("id").agg(F.min("id").alias("l"))
    shared = links.where(F.col("m").isNotNull())
    while True:
        least = shared.join(labels, "id").groupBy("m").agg(F.min("l").alias("n"), F.max("l").alias("x"))
        touched = salted_join(shared, least.where(F.col("n") < F.col("x")).select("m", "n"), ["m"], F.col("id"), "inner").groupBy("id").agg(F.min("n").alias("n"))
        reached = labels.join(touched, "id", "left")
        roots = reached.groupBy("l").agg(F.min(F.least("l", F.coalesce("n", "l"))).alias("r"))
        step = written(salted_join(reached, roots, ["l"], F.col("id"), "inner").select("id", "l", F.least("r", F.coalesce("n", "r")).alias("n")), "labels")
        if step.where(F.col("n") < F.col("l")).limit(1).count() == 0:
            break
        # a label's own new label: the row that gave it its name
        follow = step.select(F.col("id").alias("n"), F.col("n").alias("j"))
        labels = written(salted_join(step, follow, ["n"], F.col("id"), "left").select("id", F.least("n", F.coalesce("j", "n")).alias("l")), "labels")
    return labels.select(F.col("id").alias(id_col), F.col("l").alias("component"))
