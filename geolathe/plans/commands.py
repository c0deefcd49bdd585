"""Command strings: tokens, the grammar of options, variables and control flow. No data is touched here."""

from __future__ import annotations

import os
import re
import shlex
from dataclasses import dataclass, field


class CommandError(ValueError):
    """A command line that can't be understood."""


@dataclass
class Command:
    name: str
    values: list[str] = field(default_factory=list)
    options: dict[str, object] = field(default_factory=dict)

    def get(self, *names: str, default: object = None) -> object:
        for n in names:
            if n in self.options:
                return self.options[n]
        return default

    def number(self, name: str, default: float | None = None) -> float | None:
        v = self.options.get(name)
        return default if v is None else amount(str(v))

    def list(self, *names: str) -> list[str] | None:
        from geolathe.operators.table import field_list

        v = self.get(*names)
        return None if v is None else v if isinstance(v, list) else field_list(str(v))

    def numbers(self, name: str) -> list[float] | None:
        v = self.list(name)
        return None if v is None else [float(x) for x in v]

    def flag(self, name: str) -> bool:
        return bool(self.options.get(name))


# Metres in a unit.
UNITS = {"m": 1.0, "meters": 1.0, "km": 1000.0, "mi": 1609.344, "ft": 0.3048, "nmi": 1852.0}


def amount(text: str) -> float:
    """A number with a unit of length or area in metres, a percentage as a share."""
    m = re.fullmatch(r"\s*([-+]?[\d.]+(?:e[-+]?\d+)?)\s*(%|sq[a-z]+|[a-z]+2?)?\s*", text, re.I)
    if not m:
        raise CommandError(f"not a number: {text!r}")
    x, unit = float(m.group(1)), (m.group(2) or "").lower()
    if unit == "%":
        return x / 100
    square = unit.endswith("2") or unit.startswith("sq")
    unit = unit.removeprefix("sq").removesuffix("2")
    if unit and unit not in UNITS:
        raise CommandError(f"unknown unit in {text!r}")
    k = UNITS.get(unit, 1.0)
    return x * (k * k if square else k)


#: Options without a value, for all commands: a bare word that's one of these is a flag.
FLAGS = set(
    "combine-files merge-files no-topology csv-dedup-fields decimal-comma ndjson single-part force gzip cut-table single-file drop-table field-order bbox-index prettify no-quantization rfc7946 gj2008 no-null-props hoist "
    "densify geometry holes invert remove-empty keep-shapes descending ascending index verbose quantile equal-interval hybrid nice continuous non-adjacent random multipart group-points planar no-repair allow-overlaps no-snap "
    "naive point-method largest-overlap duplication dp visvalingam weighted stats scaled inner centroid vertices vertices2 endpoints midpoints interpolated segments arcs from-rings flatten apart geodesic rhumb empty "
    "no-dropouts dedup-points contiguous postprocess polygon outline aligned circles clear strict overwrite no-replace topological gaussian paek callouts simple".split()
)

#: The option that a command's first bare value stands for.
FIRST = {
    "i": "files", "o": "file", "each": "expression", "filter": "expression", "sort": "expression", "uniq": "expression", "split": "expression", "calc": "expression", "dissolve": "fields", "dissolve2": "fields",
    "filter-fields": "fields", "rename-fields": "fields", "rename-layers": "names", "join": "source", "clip": "source", "erase": "source", "slice": "source", "inlay": "source", "divide": "source", "fuzzy-join": "source", "simplify": "percentage", "subdivide": "expression",
    "inspect": "expression", "if": "expression", "elif": "expression", "target": "target", "proj": "crs", "classify": "field", "buffer": "radius", "smooth": "distance", "densify": "interval", "define": "expression",
    "run": "expression", "print": "message", "comment": "message", "lines": "fields", "split-on-grid": "cols", "snap": "interval", "include": "file", "require": "module", "graticule": "interval", "data-fill": "field", "help": "command", "rotate": "rotation", "point-grid": "grid", "style": "expression",
}

ALIASES = {"join-layers": "join", "proj4": "proj", "drop-fields": "drop", "dissolve2": "dissolve", "grid2": "grid", "filter-islands2": "filter-islands"}


def tokens(text: str) -> list[str]:
    """Words of a command line: quotes group, also behind ``=``; line breaks and backslashes at line ends part words."""
    text = re.sub(r"\\\r?\n", " ", text)
    text = "\n".join(line for line in text.split("\n") if not line.lstrip().startswith("#"))
    lexer = shlex.shlex(text, posix=True)
    lexer.whitespace_split = True
    lexer.commenters = ""
    lexer.escape = ""
    return list(lexer)


def parse(text: str | list[str]) -> list[Command]:
    """The commands of a line or a list of words. A leading program name is passed over."""
    words = tokens(text) if isinstance(text, str) else list(text)
    out: list[Command] = []
    for w in words:
        m = re.fullmatch(r"-([a-z][a-z0-9-]*)", w)
        if m:
            out.append(Command(ALIASES.get(m.group(1), m.group(1))))
            continue
        if not out:
            continue
        c = out[-1]
        if w == "+":
            c.options["no-replace"] = True
        elif w in FLAGS:
            c.options[w] = True
        elif re.match(r"^[a-z][a-z0-9-]*=", w) and not (c.name in ("each", "define", "vars", "defaults", "rename-fields", "filter-fields") and not re.match(r"^(where|ids|target|expression)=", w)):
            k, v = w.split("=", 1)
            c.options[k] = v
        else:
            key = FIRST.get(c.name)
            c.values.append(w)
            if key and key not in c.options:
                c.options[key] = w
            elif key and isinstance(c.options[key], str) and key in ("fields", "names", "files"):
                c.options[key] = f"{c.options[key]},{w}"
    return out


def filled(value: object, variables: dict[str, object]) -> object:
    """``{{name}}`` and ``{{env.NAME}}`` replaced; an unknown name is an error."""
    if isinstance(value, list):
        return [filled(v, variables) for v in value]
    if not isinstance(value, str):
        return value

    def one(m: re.Match) -> str:
        name = m.group(1).strip()
        if name.startswith("env."):
            return os.environ.get(name[4:], "")
        if name not in variables:
            raise CommandError(f"unknown variable {name}")
        v = variables[name]
        return f"{v:g}" if isinstance(v, float) else str(v)

    return re.sub(r"\{\{([^{}]+)\}\}", one, value)


def settings(words: list[str]) -> dict[str, str]:
    return dict(w.split("=", 1) for w in words if "=" in w)


class Flow:
    """The stack of ``-if`` blocks."""

    def __init__(self) -> None:
        self.stack: list[list[bool]] = []  # [active now, some branch was taken, surroundings active]

    @property
    def active(self) -> bool:
        return all(s[0] for s in self.stack)

    def handle(self, name: str, test) -> bool:  # noqa: ANN001
        """Whether the command was one of control flow; ``test()`` is only run where it matters."""
        if name == "if":
            on = self.active
            ok = bool(on and test())
            self.stack.append([ok, ok, on])
        elif name in ("elif", "else", "endif"):
            if not self.stack:
                raise CommandError(f"-{name} without -if")
            top = self.stack[-1]
            if name == "endif":
                self.stack.pop()
            else:
                top[0] = bool(top[2] and not top[1] and (name == "else" or test()))
                top[1] = top[1] or top[0]
        else:
            return False
        return True
