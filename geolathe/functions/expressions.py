"""Command expressions: a subset of JavaScript, parsed here and turned into columns. Nothing is ever evaluated as code.

``parse`` gives a list of statements (assignments and expressions) as nested tuples; ``Translator`` turns them into
Catalyst columns, so predicates can be pushed down and the work stays inside code generation. Values follow JavaScript
where SQL differs: null counts as 0 in arithmetic and in comparisons of order, ``==`` is null-safe, ``+`` with a text
concatenates, division by zero gives infinities, conditions take truthiness, and numbers are doubles.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ExpressionError(ValueError):
    """An expression that can't be parsed or that uses something outside of the subset."""


TOKEN = re.compile(
    r"""\s*(?:
    (?P<num>0[xX][0-9a-fA-F]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)
  | (?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')
  | (?P<tpl>`(?:[^`\\]|\\.)*`)
  | (?P<name>[^\W\d][\w$]*|\$[\w$]*)
  | (?P<op>===|!==|=>|\*\*=?|\?\?|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|%=|\+\+|--|[-+*/%<>=!?:.,;(){}\[\]&|])
)""",
    re.X,
)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "0": "\0"}


def unescape(body: str) -> str:
    def one(m: re.Match) -> str:
        s = m.group(1)
        if s[0] in "ux" and len(s) > 1:
            return chr(int(s[1:].strip("{}"), 16))
        return ESCAPES.get(s, s)

    return re.sub(r"\\(u\{[0-9a-fA-F]+\}|u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|.)", one, body, flags=re.S)


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while True:
        while at < len(text) and text[at].isspace():
            at += 1
        if at >= len(text):
            return [*out, ("end", "")]
        if text[at] == "/" and (not out or (out[-1][0] == "op" and out[-1][1] not in (")", "]")) or out[-1] == ("name", "return")):
            m = re.compile(r"/((?:[^/\\\[\n]|\\.|\[(?:[^\]\\]|\\.)*\])+)/([gimsuy]*)").match(text, at)
            if m:
                out.append(("re", m.group(1) + "\0" + m.group(2)))
                at = m.end()
                continue
        m = TOKEN.match(text, at)
        if not m or m.end() == at:
            raise ExpressionError(f"unexpected {text[at:at + 10]!r} in {text!r}")
        out.append((m.lastgroup or "", m.group(m.lastgroup or 0)))
        at = m.end()


BINDING = {"??": 2, "||": 3, "&&": 4, "|": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "in": 8, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 13}
ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "**="}


class Parser:
    """Precedence climbing over the tokens."""

    def __init__(self, text: str) -> None:
        self.text, self.t, self.i = text, tokens(text), 0

    def peek(self) -> tuple[str, str]:
        return self.t[self.i]

    def next(self) -> tuple[str, str]:
        self.i += 1
        return self.t[self.i - 1]

    def accept(self, op: str) -> bool:
        if self.peek() == ("op", op):
            self.i += 1
            return True
        return False

    def expect(self, op: str) -> None:
        if not self.accept(op):
            raise ExpressionError(f"expected {op!r}, found {self.peek()[1]!r} in {self.text!r}")

    def statements(self) -> list[tuple]:
        out = []
        while self.peek()[0] != "end":
            if self.accept(";") or self.accept(","):
                continue
            if self.peek()[0] == "name" and self.peek()[1] in ("var", "let", "const"):
                self.next()
            if self.peek() == ("name", "delete"):
                self.next()
                out.append(("delete", self.unary()))
                continue
            if self.peek() == ("name", "return"):
                self.next()
            out.append(self.expression())
        return out

    def expression(self, least: int = 0) -> tuple:
        left = self.unary()
        if least == 0 and self.peek()[0] == "op" and self.peek()[1] in ASSIGN:
            op = self.next()[1]
            value = self.expression()
            if left[0] not in ("name", "member", "index"):
                raise ExpressionError(f"can't assign to {left[0]} in {self.text!r}")
            return ("assign", left, value if op == "=" else ("binary", op[:-1], left, value))
        while True:
            kind, op = self.peek()
            if (kind == "op" or op == "in") and op in BINDING and BINDING[op] >= max(least, 1):
                self.next()
                right = self.expression(BINDING[op] + (op != "**"))
                left = ("binary", op, left, right)
            elif kind == "op" and op == "?" and least <= 1:
                self.next()
                yes = self.expression()
                self.expect(":")
                left = ("if", left, yes, self.expression())
            else:
                return left

    def unary(self) -> tuple:
        kind, op = self.peek()
        if kind == "op" and op in ("!", "-", "+"):
            self.next()
            return ("unary", op, self.unary())
        if (kind, op) == ("name", "typeof"):
            self.next()
            return ("unary", "typeof", self.unary())
        return self.postfix(self.primary())

    def postfix(self, node: tuple) -> tuple:
        while True:
            if self.accept("."):
                kind, name = self.next()
                if kind != "name":
                    raise ExpressionError(f"expected a name after '.' in {self.text!r}")
                node = ("member", node, name)
            elif self.accept("["):
                node = ("index", node, self.expression())
                self.expect("]")
            elif self.peek() == ("op", "("):
                node = ("call", node, self.arguments())
            elif self.peek() in (("op", "++"), ("op", "--")):
                op = self.next()[1][0]
                node = ("assign", node, ("binary", op, node, ("num", 1.0)))
            else:
                return node

    def arguments(self) -> list[tuple]:
        self.expect("(")
        out = []
        while not self.accept(")"):
            out.append(self.expression())
            if not self.accept(","):
                self.expect(")")
                break
        return out

    def primary(self) -> tuple:
        kind, text = self.next()
        if kind == "num":
            return ("num", float(int(text, 16) if text[:2] in ("0x", "0X") else text))
        if kind == "str":
            return ("str", unescape(text[1:-1]))
        if kind == "tpl":
            return self.template(text[1:-1])
        if kind == "re":
            return ("regex", *text.split("\0"))
        if kind == "name":
            if self.peek() == ("op", "=>"):
                self.next()
                return ("arrow", [text], self.expression())
            if text == "new":
                return self.postfix(self.primary())
            return ("const", {"true": True, "false": False, "null": None, "undefined": None}[text]) if text in ("true", "false", "null", "undefined") else ("name", text)
        if text == "(":
            at = self.i
            names = []
            while self.peek()[0] == "name" and not names or self.accept(","):  # (a, b) =>
                names.append(self.next()[1])
            if self.accept(")") and self.accept("=>"):
                return ("arrow", names, self.expression())
            self.i = at
            node = self.expression()
            self.expect(")")
            return node
        if text == "[":
            items = []
            while not self.accept("]"):
                items.append(self.expression())
                if not self.accept(","):
                    self.expect("]")
                    break
            return ("array", items)
        if text == "{":
            pairs = []
            while not self.accept("}"):
                k, name = self.next()
                key = unescape(name[1:-1]) if k == "str" else name
                pairs.append((key, self.expression() if self.accept(":") else ("name", key)))
                if not self.accept(","):
                    self.expect("}")
                    break
            return ("object", pairs)
        raise ExpressionError(f"unexpected {text!r} in {self.text!r}")

    def template(self, body: str) -> tuple:
        parts = re.split(r"\$\{((?:[^{}]|\{[^{}]*\})*)\}", body)
        return ("template", [("str", unescape(p)) if i % 2 == 0 else Parser(p).expression() for i, p in enumerate(parts)])


def parse(text: str) -> list[tuple]:
    """The statements of an expression."""
    return Parser(text).statements()


def walk(node: object) -> list[tuple]:
    """All nodes below and including ``node``."""
    out = [node] if isinstance(node, tuple) and node and isinstance(node[0], str) else []
    for x in node if isinstance(node, (tuple, list)) else []:
        if isinstance(x, (tuple, list)):
            out += walk(x)
    return out


def assigned(text: str) -> list[str]:
    """Names of the fields that an expression assigns to, in order."""
    names = []
    for s in parse(text):
        if s[0] == "assign":
            target = s[1]
            name = target[1] if target[0] == "name" else target[2] if target[0] == "member" else target[2][1]
            names.append(name)
    return list(dict.fromkeys(names))


# --- values --------------------------------------------------------------------------------------------------------

NUM, STR, BOOL, DATE, ARR, OBJ, NULL = "number", "string", "boolean", "date", "array", "object", "null"


@dataclass
class Value:
    """A column with what is known of its type; ``item`` is the type of an array's items."""

    col: Column
    kind: str
    item: str = NUM


def kind_of(t: T.DataType) -> tuple[str, str]:
    if isinstance(t, T.NumericType):
        return NUM, NUM
    if isinstance(t, T.BooleanType):
        return BOOL, NUM
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return DATE, NUM
    if isinstance(t, T.ArrayType):
        return ARR, kind_of(t.elementType)[0]
    if isinstance(t, (T.StructType, T.MapType)):
        return OBJ, NUM
    return (NULL, NUM) if isinstance(t, T.NullType) else (STR, STR)


def lit(value: object) -> Value:
    if value is None:
        return Value(F.lit(None), NULL)
    if isinstance(value, bool):
        return Value(F.lit(value), BOOL)
    if isinstance(value, (int, float)):
        return Value(F.lit(float(value)), NUM)
    if isinstance(value, (list, tuple)):
        items = [lit(v) for v in value]
        return Value(F.array(*[i.col for i in items]), ARR, items[0].kind if items else NUM)
    return Value(F.lit(value), STR)


def number(v: Value) -> Column:
    """The value as a double, null as 0 (as arithmetic takes it)."""
    return F.coalesce(plain_number(v), F.lit(0.0)) if v.kind != NULL else F.lit(0.0)


def plain_number(v: Value) -> Column:
    """The value as a double; null stays null."""
    if v.kind == NUM:
        return v.col.cast("double")
    if v.kind == BOOL:
        return v.col.cast("int").cast("double")
    if v.kind == DATE:
        return F.unix_millis(v.col.cast("timestamp")).cast("double")
    if v.kind == NULL:
        return F.lit(None).cast("double")
    text = F.trim(v.col.cast("string"))
    return F.when(v.col.isNull(), F.lit(None)).when(text == "", F.lit(0.0)).otherwise(F.coalesce(text.try_cast("double"), F.lit(float("nan"))))


def number_text(c: Column) -> Column:
    """A number as text, whole ones without a point."""
    whole = (F.abs(c) < 1e15) & (c == F.floor(c))
    return F.when(whole, c.cast("long").cast("string")).when(F.isnan(c), "NaN").otherwise(c.cast("string"))


def text(v: Value, null: str = "null") -> Column:
    """The value as text, as concatenation takes it."""
    if v.kind == NUM:
        out = number_text(v.col.cast("double"))
    elif v.kind in (ARR, OBJ):
        out = F.to_json(v.col)
    elif v.kind == NULL:
        return F.lit(null)
    elif v.kind == DATE:
        out = F.date_format(v.col.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    else:
        out = v.col.cast("string")
    return F.coalesce(out, F.lit(null))


def truth(v: Value) -> Column:
    """Truthiness: null, NaN, 0 and the empty text are false."""
    if v.kind == BOOL:
        return F.coalesce(v.col, F.lit(False))
    if v.kind == NUM:
        d = v.col.cast("double")
        return F.coalesce((d != 0) & ~F.isnan(d), F.lit(False))
    if v.kind == STR:
        return F.coalesce(v.col != "", F.lit(False))
    return F.lit(False) if v.kind == NULL else v.col.isNotNull()


def same(a: Value, b: Value) -> Column:
    if a.kind == NULL or b.kind == NULL:
        return (b if a.kind == NULL else a).col.isNull()
    if a.kind == b.kind and a.kind != NUM:
        return a.col.eqNullSafe(b.col)
    if {a.kind, b.kind} <= {NUM, BOOL, STR}:
        x, y = plain_number(a), plain_number(b)
        return x.eqNullSafe(y) & ~F.coalesce(F.isnan(x), F.lit(False))
    return text(a).eqNullSafe(text(b))


def divide(a: Column, b: Column) -> Column:
    inf = F.lit(float("inf"))
    return F.when(b != 0, a / F.when(b != 0, b)).when((a == 0) | F.isnan(a), F.lit(float("nan"))).when(a > 0, inf).otherwise(-inf)


def js_round(x: Column, digits: int | Column = 0) -> Column:
    """Half up, towards positive infinity; NaN stays NaN, null stays null."""
    k = F.lit(10.0 ** digits) if isinstance(digits, int) else F.pow(F.lit(10.0), digits)
    r = F.floor(x * k + 0.5).cast("double") / k
    return F.when(F.isnan(x) | (F.abs(x) >= 1e15), x).otherwise(r)


def sprintf(fmt: str, args: list[Value]) -> Column:
    """``%[+0',][width][.precision][sdifxX%]``; a negative number gets the true minus sign."""
    parts: list[Column] = []
    at, n = 0, 0
    for m in re.finditer(r"%([+0',]*)([1-9][0-9]*)?(?:\.([0-9]+))?([sdifxX%])", fmt):
        parts.append(F.lit(fmt[at : m.start()]))
        at = m.end()
        flags, width, precision, conv = m.group(1), int(m.group(2) or 0), m.group(3), m.group(4)
        if conv == "%":
            parts.append(F.lit("%"))
            continue
        if n >= len(args):
            raise ExpressionError(f"too few values for the format {fmt!r}")
        v, n = args[n], n + 1
        if conv == "s":
            parts.append(F.lpad(text(v), width, " ") if width else text(v))
            continue
        x = number(v)
        size = F.abs(x)
        if conv in "xX":
            digits = F.hex(js_round(size).cast("long"))
            digits = F.lower(digits) if conv == "x" else digits
        else:
            places = int(precision) if precision is not None else None
            if conv in "di":
                grouped = F.format_number(js_round(size), 0)
            elif places is not None:
                grouped = F.format_number(js_round(size, places), places)
            else:
                grouped = number_text(size)
            digits = grouped if "'" in flags or "," in flags else F.regexp_replace(grouped, ",", "")
        sign = F.when(x < 0, "−").otherwise("+" if "+" in flags else "")
        body = F.concat(sign, digits)
        if width:
            body = F.when(F.length(body) >= width, body).otherwise(F.concat(sign, F.lpad(digits, F.lit(width) - F.length(sign), F.lit("0"))) if "0" in flags else F.lpad(body, width, " "))
        parts.append(body)
    parts.append(F.lit(fmt[at:]))
    return F.concat(*parts)


def parse_dms(s: Column) -> Column:
    """Degrees, minutes and seconds, with a sign or a letter of the compass, as decimal degrees; null if unreadable."""
    pattern = r"^\s*([-−+NSEWnsew]?)\s*(\d+(?:\.\d+)?)\s*[°º:\s]?\s*(?:(\d+(?:\.\d+)?)\s*['′:\s]?\s*(?:(\d+(?:\.\d+)?)\s*[\"″]?)?)?\s*([NSEWnsew]?)\s*$"
    at = lambda i: F.regexp_extract(s, pattern, i)
    size = at(2).try_cast("double") + F.coalesce(at(3).try_cast("double"), F.lit(0.0)) / 60 + F.coalesce(at(4).try_cast("double"), F.lit(0.0)) / 3600
    minus = at(1).isin("-", "−") | F.upper(F.concat(at(1), at(5))).rlike("[SW]")
    return F.when(s.rlike(pattern), F.when(minus, -size).otherwise(size))


def format_dms(x: Column, fmt: str = "[-]D°M′S.SSS″") -> Column:
    """Decimal degrees in a format of D, M and S runs (with decimals), ``[-]``, ``[+-]``, ``[NS]`` or ``[EW]``."""
    runs = re.findall(r"D+(?:\.D+)?|M+(?:\.M+)?|S+(?:\.S+)?", fmt)
    unit = runs[-1][0] if runs else "D"
    places = len(runs[-1].split(".")[1]) if runs and "." in runs[-1] else 0
    scale = {"D": 1, "M": 60, "S": 3600}[unit]
    total = js_round(F.abs(x) * scale, places)
    pieces: dict[str, Column] = {}
    if unit == "D":
        pieces["D"] = total
    elif unit == "M":
        pieces["D"] = F.floor(total / 60)
        pieces["M"] = total - pieces["D"] * 60
    else:
        pieces["D"] = F.floor(total / 3600)
        pieces["M"] = F.floor((total - pieces["D"] * 3600) / 60)
        pieces["S"] = total - pieces["D"] * 3600 - pieces["M"] * 60
    out: list[Column] = []
    for part in re.split(r"(D+(?:\.D+)?|M+(?:\.M+)?|S+(?:\.S+)?|\[[^\]]*\])", fmt):
        if not part:
            continue
        if part[0] in "DMS" and part[0] in pieces:
            whole, decimals = len(part.split(".")[0]), len(part.split(".")[1]) if "." in part else 0
            body = F.regexp_replace(F.format_number(pieces[part[0]].cast("double"), decimals), ",", "")
            width = whole + (decimals + 1 if decimals else 0)
            out.append(F.when(F.length(body) >= width, body).otherwise(F.lpad(body, width, "0")))
        elif part.startswith("["):
            options = part[1:-1].split(",") if "," in part else list(part[1:-1])
            if "-" in options:
                out.append(F.when(x < 0, "-").otherwise("+" if "+" in options else ""))
            elif len(options) == 2:
                plus, minus = (options[0], options[1]) if options[0].upper() in ("N", "E") else (options[1], options[0])
                out.append(F.when(x < 0, minus).otherwise(plus))
        else:
            out.append(F.lit(part))
    return F.when(x.isNotNull(), F.concat(*out))


COLOURS = {"black": (0, 0, 0), "white": (255, 255, 255), "red": (255, 0, 0), "green": (0, 128, 0), "blue": (0, 0, 255), "yellow": (255, 255, 0), "orange": (255, 165, 0), "grey": (128, 128, 128), "gray": (128, 128, 128), "purple": (128, 0, 128)}


def rgb(c: Column) -> list[Column]:
    """Red, green and blue of ``#rgb``, ``#rrggbb``, ``rgb(r,g,b)`` and some names; null where unreadable."""
    c = F.lower(F.trim(c))
    short = F.regexp_replace(c, "^#([0-9a-f])([0-9a-f])([0-9a-f])$", "#$1$1$2$2$3$3")
    named = F.create_map(*[F.lit(x) for n, v in COLOURS.items() for x in (n, "#%02x%02x%02x" % v)])
    hexed = F.coalesce(F.try_element_at(named, short), short)
    out = []
    for i in range(3):
        h = F.conv(F.regexp_extract(hexed, "^#([0-9a-f]{2})([0-9a-f]{2})([0-9a-f]{2})$", i + 1), 16, 10).try_cast("double")
        f = F.regexp_extract(c, r"^rgba?\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)", i + 1).try_cast("double")
        out.append(F.coalesce(f, h))
    return out


def blend(pairs: list[tuple[Column, Column]]) -> Column:
    """Colours mixed by weight as ``#rrggbb``; ``#eee`` if no weight is positive."""
    weights = [F.greatest(F.coalesce(w, F.lit(0.0)), F.lit(0.0)) for _, w in pairs]
    total = sum(weights[1:], weights[0])
    parts = [rgb(c) for c, _ in pairs]
    mixed = [js_round(sum((p[i] * w for p, w in zip(parts[1:], weights[1:])), parts[0][i] * weights[0]) / F.when(total > 0, total)).cast("long") for i in range(3)]
    return F.when(total > 0, F.concat(F.lit("#"), *[F.lower(F.lpad(F.hex(m), 2, "0")) for m in mixed])).otherwise("#eee")


# --- translation ---------------------------------------------------------------------------------------------------


@dataclass
class Translator:
    """Turns parsed expressions into columns over the fields of a schema.

    ``fields``: name -> Value; ``this``: members of ``this`` (area, x, ...); ``defs``: constants and arrow functions
    from ``-define``; ``calls``: further functions (aggregates); ``scope``: bound names of arrow functions.
    """

    fields: dict[str, Value]
    this: dict[str, Callable[[], Value]] = field(default_factory=dict)
    defs: dict[str, object] = field(default_factory=dict)
    calls: dict[str, Callable[[list, Translator], Value]] = field(default_factory=dict)
    others: dict[str, dict[str, Value]] = field(default_factory=dict)
    scope: dict[str, Value] = field(default_factory=dict)
    unknown_null: bool = False

    @classmethod
    def of(cls, schema: T.StructType, **options: object) -> Translator:
        own = {f.name: Value(F.col(f"`{f.name}`"), *kind_of(f.dataType)) for f in schema.fields}
        return cls(own, **options)  # type: ignore[arg-type]

    def column(self, expr: str) -> Value:
        """The value of a single expression."""
        nodes = parse(expr)
        if len(nodes) != 1:
            raise ExpressionError(f"expected one expression: {expr!r}")
        return self.value(nodes[0])

    def with_scope(self, names: dict[str, Value]) -> Translator:
        return Translator(self.fields, self.this, self.defs, self.calls, self.others, {**self.scope, **names}, self.unknown_null)

    def value(self, n: tuple) -> Value:
        return getattr(self, f"_{n[0]}")(n)

    def _num(self, n: tuple) -> Value:
        return lit(n[1])

    _str = _const = _num

    def _name(self, n: tuple) -> Value:
        name = n[1]
        if name in self.scope:
            return self.scope[name]
        if name in self.fields:
            return self.fields[name]
        if name in self.defs and not isinstance(self.defs[name], tuple):
            return lit(self.defs[name])
        if name in ("NaN", "Infinity"):
            return lit(float("nan") if name == "NaN" else float("inf"))
        if self.unknown_null:
            return lit(None)
        raise ExpressionError(f"unknown name {name!r}")

    def _template(self, n: tuple) -> Value:
        return Value(F.concat(*[text(self.value(p)) for p in n[1]]), STR)

    def _array(self, n: tuple) -> Value:
        items = [self.value(i) for i in n[1]]
        return Value(F.array(*[i.col for i in items]), ARR, items[0].kind if items else NUM)

    def _object(self, n: tuple) -> Value:
        return Value(F.struct(*[self.value(v).col.alias(k) for k, v in n[1]]), OBJ)

    def _if(self, n: tuple) -> Value:
        test, a, b = truth(self.value(n[1])), self.value(n[2]), self.value(n[3])
        if a.kind == b.kind or NULL in (a.kind, b.kind):
            return Value(F.when(test, a.col).otherwise(b.col), b.kind if a.kind == NULL else a.kind, b.item if a.kind == NULL else a.item)
        return Value(F.when(test, F.when(a.col.isNotNull(), text(a))).otherwise(F.when(b.col.isNotNull(), text(b))), STR)

    def _unary(self, n: tuple) -> Value:
        v = self.value(n[2])
        if n[1] == "!":
            return Value(~truth(v), BOOL)
        if n[1] == "typeof":
            return Value(F.when(v.col.isNull(), "object").otherwise("object" if v.kind in (ARR, OBJ, DATE, NULL) else v.kind), STR)
        return Value(-number(v) if n[1] == "-" else number(v), NUM)

    def _binary(self, n: tuple) -> Value:
        op = n[1]
        a, b = self.value(n[2]), self.value(n[3])
        if op in ("&&", "||"):
            t = truth(a)
            if a.kind == b.kind == BOOL:
                return Value((t & truth(b)) if op == "&&" else (t | truth(b)), BOOL)
            yes, no = (b, a) if op == "&&" else (a, b)
            if a.kind == b.kind or NULL in (a.kind, b.kind):
                return Value(F.when(t, yes.col).otherwise(no.col), b.kind if a.kind == NULL else a.kind)
            return Value((t & truth(b)) if op == "&&" else (t | truth(b)), BOOL)
        if op == "??":
            return Value(F.coalesce(a.col, b.col), b.kind if a.kind == NULL else a.kind)
        if op in ("==", "===", "!=", "!=="):
            eq = same(a, b) if len(op) == 2 or a.kind == b.kind or NULL in (a.kind, b.kind) else F.lit(False)
            return Value(eq if op[0] == "=" else ~eq, BOOL)
        if op == "in":
            return Value(F.array_contains(b.col, a.col), BOOL)
        if op in ("<", ">", "<=", ">="):
            x, y = (a.col, b.col) if a.kind == b.kind and a.kind in (STR, DATE) else (number(a), number(b))
            nan = F.lit(False) if a.kind == b.kind and a.kind in (STR, DATE) else F.isnan(x) | F.isnan(y)
            r = {"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]
            return Value(F.coalesce(r & ~nan, F.lit(False)), BOOL)
        if op == "+" and (STR in (a.kind, b.kind) or ARR in (a.kind, b.kind) or OBJ in (a.kind, b.kind)):
            return Value(F.concat(text(a), text(b)), STR)
        x, y = number(a), number(b)
        if op == "/":
            return Value(divide(x, y), NUM)
        if op == "%":
            return Value(F.when(y != 0, x % F.when(y != 0, y)).otherwise(F.lit(float("nan"))), NUM)
        if op in ("&", "|"):
            p, q = x.cast("long"), y.cast("long")
            return Value((p.bitwiseAND(q) if op == "&" else p.bitwiseOR(q)).cast("double"), NUM)
        return Value({"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "**": lambda: F.pow(x, y)}[op](), NUM)

    def _index(self, n: tuple) -> Value:
        if n[1][0] == "name" and n[1][1] in ("d", "_") and n[2][0] == "str":
            return self._name(("name", n[2][1]))
        base, at = self.value(n[1]), self.value(n[2])
        if base.kind == OBJ:
            return Value(base.col[at.col], STR)
        if base.kind == STR:
            return Value(F.substring(base.col, number(at).cast("int") + 1, F.lit(1)), STR)
        return Value(F.get(base.col, number(at).cast("int")), base.item)

    def _member(self, n: tuple) -> Value:
        base, name = n[1], n[2]
        if base[0] == "name" and base[1] not in self.scope:
            if base[1] in self.others:  # target.x, A.x, B.x
                other = self.others[base[1]]
                if name in other:
                    return other[name]
                if self.unknown_null:
                    return lit(None)
                raise ExpressionError(f"unknown field {base[1]}.{name}")
            if base[1] == "this":
                if name == "properties":
                    raise ExpressionError("this.properties needs a member")
                if name in self.this:
                    return self.this[name]()
                raise ExpressionError(f"unknown member this.{name}")
            if base[1] in ("d", "_", "global"):
                return self._name(("name", name))
            if base[1] == "Math" and name in ("PI", "E"):
                return lit({"PI": 3.141592653589793, "E": 2.718281828459045}[name])
        if base == ("member", ("name", "this"), "properties"):
            return self._name(("name", name))
        v = self.value(base)
        if name == "length":
            return Value((F.length(v.col) if v.kind == STR else F.size(v.col)).cast("double"), NUM)
        return Value(v.col.getField(name), STR if v.kind != OBJ else STR)

    def _regex(self, n: tuple) -> Value:
        raise ExpressionError("a regular expression can only be an argument or tested")

    def _assign(self, n: tuple) -> Value:
        raise ExpressionError("an assignment can't be part of an expression")

    def _arrow(self, n: tuple) -> Value:
        raise ExpressionError("a function can only be an argument")

    def _call(self, n: tuple) -> Value:
        f, args = n[1], n[2]
        if f[0] == "name":
            return self.function(f[1], args)
        if f[0] == "member" and f[1] == ("name", "Math"):
            return self.math(f[2], [self.value(a) for a in args])
        if f[0] == "member" and f[1] == ("name", "JSON"):
            v = self.value(args[0])
            return Value(F.to_json(v.col) if v.kind in (ARR, OBJ) else text(v), STR) if f[2] == "stringify" else Value(v.col, STR)
        if f[0] == "member" and f[1] == ("name", "Number"):
            return self.function({"isNaN": "isNaN", "parseFloat": "parseFloat", "parseInt": "parseInt"}.get(f[2], f[2]), args)
        if f[0] == "member" and f[1] == ("name", "Array") and f[2] == "isArray":
            v = self.value(args[0])
            return Value(v.col.isNotNull() if v.kind == ARR else F.lit(False), BOOL)
        if f[0] == "member" and f[1][0] == "regex" and f[2] == "test":
            return Value(F.coalesce(text(self.value(args[0])).rlike(pattern(f[1])), F.lit(False)), BOOL)
        if f[0] == "member":
            if f[1] == ("name", "this") and f[2] in self.calls:
                return self.calls[f[2]](args, self)
            return self.method(self.value(f[1]), f[2], args)
        raise ExpressionError("this can't be called")

    def math(self, name: str, args: list[Value]) -> Value:
        x = [number(a) for a in args]
        one = {
            "abs": F.abs, "sqrt": F.sqrt, "exp": F.exp, "log": lambda c: F.when(c > 0, F.log(c)).when(c == 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan"))), "log10": F.log10, "log2": F.log2,
            "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "sign": F.signum, "cbrt": F.cbrt,
            "floor": lambda c: F.when(F.isnan(c), c).otherwise(F.floor(c).cast("double")), "ceil": lambda c: F.when(F.isnan(c), c).otherwise(F.ceil(c).cast("double")),
            "round": js_round, "trunc": lambda c: F.when(c < 0, F.ceil(c).cast("double")).otherwise(F.floor(c).cast("double")),
        }
        if name in one:
            return Value(one[name](x[0]), NUM)
        if name in ("min", "max"):
            return Value(x[0] if len(x) == 1 else (F.least if name == "min" else F.greatest)(*x), NUM)
        if name in ("pow", "atan2", "hypot"):
            return Value({"pow": F.pow, "atan2": F.atan2, "hypot": F.hypot}[name](x[0], x[1]), NUM)
        raise ExpressionError(f"unknown function Math.{name}")

    def function(self, name: str, args: list[tuple]) -> Value:
        if name in self.calls:
            return self.calls[name](args, self)
        if name in self.defs and isinstance(self.defs[name], tuple):
            _, params, body = self.defs[name]  # type: ignore[misc]
            return self.with_scope({p: self.value(a) for p, a in zip(params, args)}).value(body)
        v = [self.value(a) for a in args]
        if name == "round":
            digits = args[1][1] if len(args) > 1 and args[1][0] == "num" else None
            return Value(js_round(plain_number(v[0]), int(digits) if digits is not None else number(v[1]) if len(v) > 1 else 0), NUM)
        if name in ("Number", "parseFloat"):
            if name == "parseFloat" and v[0].kind == STR:
                return Value(F.coalesce(F.regexp_extract(v[0].col, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double"), F.lit(float("nan"))), NUM)
            return Value(number(v[0]), NUM)
        if name == "parseInt":
            whole = F.regexp_extract(text(v[0]), r"^\s*([+-]?\d+)", 1).try_cast("double")
            return Value(F.coalesce(whole, F.lit(float("nan"))), NUM)
        if name == "String":
            return Value(text(v[0]), STR)
        if name == "Boolean":
            return Value(truth(v[0]), BOOL)
        if name == "isNaN":
            return Value(F.isnan(number(v[0])), BOOL)
        if name == "isFinite":
            x = number(v[0])
            return Value(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), BOOL)
        if name == "Date":
            return Value(v[0].col.cast("timestamp") if v[0].kind != NUM else F.timestamp_millis(v[0].col.cast("long")), DATE)
        if name in ("sprintf", "format"):
            return Value(sprintf(args[0][1], v[1:]), STR)
        if name == "parse_dms":
            return Value(parse_dms(v[0].col.cast("string")), NUM)
        if name == "format_dms":
            return Value(format_dms(plain_number(v[0]), args[1][1]) if len(args) > 1 else format_dms(plain_number(v[0])), STR)
        if name == "blend":
            if v[0].kind == ARR:
                colours, weights = args[0][1], args[1][1]
                return Value(blend([(self.value(c).col, number(self.value(w))) for c, w in zip(colours, weights)]), STR)
            return Value(blend([(v[i].col, number(v[i + 1])) for i in range(0, len(v) - 1, 2)]), STR)
        if name == "int_median":
            return Value(interpolated_median(v[0].col, v[1].col), NUM)
        raise ExpressionError(f"unknown function {name}()")

    def method(self, v: Value, name: str, args: list[tuple]) -> Value:
        if v.kind == ARR:
            return self.array_method(v, name, args)
        if v.kind == DATE:
            return self.date_method(v.col.cast("timestamp"), name)
        if name == "toFixed":
            places = int(args[0][1]) if args else 0
            return Value(F.regexp_replace(F.format_number(js_round(number(v), places), places), ",", ""), STR)
        if name == "toString":
            return Value(text(v), STR)
        if name == "toLocaleString":
            return Value(F.regexp_replace(F.format_number(js_round(number(v), 3), 3), r"\.?0+$", ""), STR)
        s = text(v)
        if name == "replace" or name == "replaceAll":
            new = text(self.value(args[1]))
            if args[0][0] == "regex":
                new = F.regexp_replace(new, r"\$&", r"\$0")
                everywhere = "g" in args[0][2]
                return Value(F.regexp_replace(s, F.lit(pattern(args[0])), new) if everywhere else _first(s, pattern(args[0]), new), STR)
            old = text(self.value(args[0]))
            if name == "replaceAll":
                return Value(F.replace(s, old, new), STR)
            at = F.instr(s, old)
            return Value(F.when(at > 0, F.concat(F.substring(s, F.lit(1), at - 1), new, F.substring(s, at + F.length(old), F.length(s)))).otherwise(s), STR)
        if name == "match":
            m = F.regexp_extract_all(s, F.lit(pattern(args[0])), F.lit(0))
            return Value(F.when(F.size(m) > 0, m), ARR, STR)
        if name == "split":
            by = pattern(args[0]) if args[0][0] == "regex" else re.escape(args[0][1])
            return Value(F.split(s, by), ARR, STR)
        a = [self.value(x) for x in args]
        whole = lambda i, default=None: number(a[i]).cast("int") if len(a) > i else default
        if name in ("toUpperCase", "toLocaleUpperCase"):
            return Value(F.upper(s), STR)
        if name in ("toLowerCase", "toLocaleLowerCase"):
            return Value(F.lower(s), STR)
        if name in ("trim", "trimStart", "trimEnd"):
            left, right = name != "trimEnd", name != "trimStart"
            s = F.regexp_replace(s, r"\A(?U)\s+", "") if left else s
            return Value(F.regexp_replace(s, r"(?U)\s+\z", "") if right else s, STR)
        if name in ("includes", "startsWith", "endsWith"):
            return Value({"includes": F.contains, "startsWith": F.startswith, "endsWith": F.endswith}[name](s, text(a[0])), BOOL)
        if name == "indexOf":
            return Value((F.instr(s, text(a[0])) - 1).cast("double"), NUM)
        if name == "charAt":
            return Value(F.substring(s, whole(0, F.lit(0)) + 1, F.lit(1)), STR)
        if name == "charCodeAt":
            return Value(F.ascii(F.substring(s, whole(0, F.lit(0)) + 1, F.lit(1))).cast("double"), NUM)
        n = F.length(s)
        if name in ("substr", "slice", "substring"):
            begin = whole(0, F.lit(0))
            if name == "substring":
                x, y = [F.greatest(F.lit(0), F.least(n, q)) for q in (begin, whole(1, n))]
                begin, end = F.least(x, y), F.greatest(x, y)
            else:
                begin = F.when(begin < 0, F.greatest(F.lit(0), n + begin)).otherwise(F.least(begin, n))
                end = begin + F.greatest(F.lit(0), whole(1, n)) if name == "substr" else whole(1, n)
                end = F.when(end < 0, n + end).otherwise(end) if name == "slice" else end
            return Value(F.substring(s, begin + 1, F.greatest(F.lit(0), end - begin)), STR)
        if name in ("padStart", "padEnd"):
            pad = text(a[1]) if len(a) > 1 else F.lit(" ")
            return Value(F.when(n >= whole(0), s).otherwise((F.lpad if name == "padStart" else F.rpad)(s, whole(0), pad)), STR)
        if name == "repeat":
            return Value(F.repeat(s, whole(0)), STR)
        if name == "concat":
            return Value(F.concat(s, *[text(x) for x in a]), STR)
        raise ExpressionError(f"unknown method {name}()")

    def array_method(self, v: Value, name: str, args: list[tuple]) -> Value:
        if args and args[0][0] == "arrow":
            _, params, body = args[0]
            inner = lambda x: self.with_scope({params[0]: Value(x, v.item)}).value(body)
            if name == "map":
                kinds: list[str] = []

                def mapped(x: Column) -> Column:
                    r = inner(x)
                    kinds.append(r.kind)
                    return r.col

                c = F.transform(v.col, mapped)
                return Value(c, ARR, kinds[-1])
            if name == "filter":
                return Value(F.filter(v.col, lambda x: truth(inner(x))), ARR, v.item)
            if name in ("some", "every"):
                return Value((F.exists if name == "some" else F.forall)(v.col, lambda x: truth(inner(x))), BOOL)
        a = [self.value(x) for x in args]
        if name == "includes":
            return Value(F.array_contains(v.col, a[0].col), BOOL)
        if name == "indexOf":
            return Value((F.array_position(v.col, a[0].col) - 1).cast("double"), NUM)
        if name == "join":
            items = F.transform(v.col, lambda x: text(Value(x, v.item), ""))
            return Value(F.array_join(items, args[0][1] if args else ","), STR)
        if name == "slice":
            n = F.size(v.col)
            begin = number(a[0]).cast("int") if a else F.lit(0)
            end = number(a[1]).cast("int") if len(a) > 1 else n
            begin, end = [F.when(q < 0, F.greatest(F.lit(0), n + q)).otherwise(F.least(q, n)) for q in (begin, end)]
            return Value(F.slice(v.col, begin + 1, F.greatest(F.lit(0), end - begin)), ARR, v.item)
        if name == "concat":
            return Value(F.concat(v.col, *[x.col for x in a]), ARR, v.item)
        if name == "reverse":
            return Value(F.reverse(v.col), ARR, v.item)
        if name == "sort":
            return Value(F.array_sort(v.col), ARR, v.item)
        raise ExpressionError(f"unknown method {name}() of arrays")

    def date_method(self, c: Column, name: str) -> Value:
        parts = {"getFullYear": F.year(c), "getMonth": F.month(c) - 1, "getDate": F.dayofmonth(c), "getDay": F.dayofweek(c) - 1, "getHours": F.hour(c), "getMinutes": F.minute(c), "getSeconds": F.second(c), "getTime": F.unix_millis(c)}
        plain = name.replace("UTC", "")
        if plain in parts:
            return Value(parts[plain].cast("double"), NUM)
        if name in ("toISOString", "toJSON"):
            return Value(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), STR)
        raise ExpressionError(f"unknown method {name}() of dates")


def pattern(node: tuple) -> str:
    """A regular expression node in Java's notation."""
    if node[0] == "str":
        return re.escape(node[1])
    if node[0] != "regex":
        raise ExpressionError("expected a regular expression")
    flags = "".join(f for f in node[2] if f in "ims")
    return (f"(?{flags})" if flags else "") + node[1].replace("\\/", "/")


def _first(s: Column, pat: str, new: Column) -> Column:
    """``s`` with its first match replaced."""
    whole = F.regexp_extract(s, pat, 0)
    at = F.instr(s, whole)
    changed = F.regexp_replace(whole, F.lit(pat), new)
    return F.when(s.rlike(pat), F.concat(F.substring(s, F.lit(1), at - 1), changed, F.substring(s, at + F.length(whole), F.length(s)))).otherwise(s)


def interpolated_median(counts: Column, breaks: Column) -> Column:
    """Median of a histogram, interpolated within its class; ``breaks`` are the bounds, one more than ``counts``."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    half = total / 2
    running = F.transform(F.sequence(F.lit(1), F.size(counts)), lambda i: F.aggregate(F.slice(counts, 1, i), F.lit(0.0), lambda a, x: a + x))
    at = F.aggregate(running, F.lit(1), lambda a, x: a + F.when(x < half, 1).otherwise(0))
    before = F.coalesce(F.get(running, at - 2), F.lit(0.0))
    low, high, n = F.get(breaks, at - 1), F.get(breaks, at), F.get(counts, at - 1)
    return F.when(total > 0, low + (high - low) * (half - before) / n)
