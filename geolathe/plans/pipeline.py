"""Running commands over layers: every command maps DataFrames to DataFrames, and nothing runs before its result is
needed (an output, an aggregate, a condition)."""

from __future__ import annotations

import fnmatch
import glob
import json
import math
import random
import re
import sys
from collections.abc import Callable
from dataclasses import replace
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolathe import __version__
from geolathe.functions import projections as PR
from geolathe.functions.expressions import Translator, Value, lit, parse as parse_expression
from geolathe.layer import FID, GEOM, Layer, LayerError, layer_of
from geolathe.operators import classify as CL
from geolathe.operators import joins as J
from geolathe.operators import overlay as O
from geolathe.operators import paths as PA
from geolathe.operators import points as P
from geolathe.operators import table as T
from geolathe.operators import topology as TO
from geolathe.plans.commands import Command, CommandError, Flow, filled, parse, settings
from geolathe.sources import io as IO


class Pipeline:
    """A session: named layers, definitions and variables, and the commands that work on them.

    ``inputs`` holds DataFrames, layers or file contents that ``-i`` finds by name before it looks for files;
    ``external`` holds further commands, functions from a layer and options to a layer.
    """

    def __init__(self, spark: SparkSession, inputs: dict[str, object] | None = None, external: dict[str, Callable] | None = None) -> None:
        self.spark = spark
        self.inputs = dict(inputs or {})
        self.layers: dict[str, Layer] = {}
        self.targets: list[str] = []
        self.defs: dict[str, object] = {}
        self.vars: dict[str, object] = {}
        self.defaults: dict[str, object] = {}
        self.outputs: dict[str, object] = {}
        self.messages: list[str] = []
        self.external = dict(external or {})
        self.flow = Flow()
        self.stopped = False

    # --- running -----------------------------------------------------------------------------------------------

    def run(self, text: str | list[str]) -> Pipeline:
        """Runs commands, one after the other; ``layer()`` and ``outputs`` have the results."""
        for c in parse(text):
            if self.stopped:
                break
            if c.name not in ("if", "elif", "else", "endif") and not self.flow.active:
                continue
            variables = {**self.defaults, **self.vars}
            c = Command(c.name, [str(filled(v, variables)) for v in c.values], {k: filled(v, variables) for k, v in c.options.items()})
            if self.flow.handle(c.name, lambda c=c: self.test(str(c.get("expression")), c)):
                continue
            self.dispatch(c)
        return self

    def layer(self, name: str | None = None) -> Layer:
        """A layer by name, or the current target."""
        names = [name] if name else self.targets[-1:]
        if not names or names[0] not in self.layers:
            raise CommandError(f"no layer {name or ''}")
        return self.layers[names[0]]

    def dispatch(self, c: Command) -> None:
        method = getattr(self, "do_" + c.name.replace("-", "_"), None)
        if method:
            method(c)
        elif c.name in PER_LAYER:
            self.each_layer(c, PER_LAYER[c.name])
        elif c.name in self.external:
            self.each_layer(c, lambda p, x, c: self.external[c.name](x, c.options))
        else:
            raise CommandError(f"unknown command -{c.name}")

    # --- catalog -----------------------------------------------------------------------------------------------

    def find(self, pattern: str) -> list[str]:
        """Layers by name, wildcard, number (from 1) or ``*``, comma-separated."""
        out: list[str] = []
        for p in T.field_list(pattern):
            names = list(self.layers)
            if p.isdigit() and p not in names:
                got = names[int(p) - 1 : int(p)]
            else:
                got = [n for n in names if fnmatch.fnmatchcase(n, p)]
            if not got:
                raise CommandError(f"no layer matches {p}")
            out += got
        return list(dict.fromkeys(out))

    def chosen(self, c: Command) -> list[str]:
        names = self.find(str(c.get("target"))) if c.get("target") else self.targets
        if not names:
            raise CommandError(f"-{c.name} has no layer to work on")
        return names

    def put(self, layer: Layer, name: str | None = None) -> str:
        name = name or layer.name or f"layer{len(self.layers) + 1}"
        self.layers[name] = replace(layer, name=name)
        return name

    def each_layer(self, c: Command, f: Callable) -> None:
        """Replaces each target by the result, or adds it beside (``+``); a result may be several layers."""
        done: list[str] = []
        for name in self.chosen(c):
            result = f(self, self.layers[name], c)
            if isinstance(result, dict):
                if not c.flag("no-replace"):
                    self.layers.pop(name)
                done += [self.put(x, n) for n, x in result.items()]
            elif c.flag("no-replace"):
                new = str(c.get("name") or f"{name}-{c.name}")
                done.append(self.put(result, new))
            else:
                if c.get("name"):
                    self.layers.pop(name)
                done.append(self.put(result, str(c.get("name") or name)))
        self.targets = done

    def source(self, name: str) -> Layer:
        if name in self.layers:
            return self.layers[name]
        return next(iter(self.read(name, Command("i")).values()))

    # --- input and output --------------------------------------------------------------------------------------

    def read(self, path: str, c: Command) -> dict[str, Layer]:
        name = str(c.get("name") or Path(path).stem)
        given = self.inputs.get(path)
        if isinstance(given, Layer):
            return {name: replace(given, name=name)}
        if isinstance(given, DataFrame):
            return {name: layer_of(given, name, key=c.get("id-field"))}  # type: ignore[arg-type]
        if isinstance(given, str):
            return self.read_text(path, given, name, c)
        if path.lstrip().startswith(("{", "[")):
            return self.read_text("inline.json", path, str(c.get("name") or "layer"), c)
        kind = IO.file_type(path)
        if kind == "csv":
            o = dict(string_fields=c.list("string-fields"), field_types=dict(x.split(":") for x in c.list("field-types") or []), fields=c.list("csv-fields"), where=c.get("csv-filter"), lines=int(c.number("csv-lines")) if c.get("csv-lines") else None,  # type: ignore[arg-type]
                     skip_lines=int(c.number("csv-skip-lines") or 0), field_names=c.list("csv-field-names"), decimal_comma=c.flag("decimal-comma"), encoding=str(c.get("encoding") or "UTF-8"), delimiter=c.get("delimiter"))
            return {name: IO.read_csv(self.spark, path, name=name, **o)}  # type: ignore[arg-type]
        if kind in ("json", "ndjson"):
            return IO.read_json(self.spark, path, c.get("json-path"), kind == "ndjson" or c.flag("ndjson"), name)  # type: ignore[arg-type]
        if kind in ("shp", "dbf"):
            return IO.read_shapefile(self.spark, path, c.get("encoding"), name)  # type: ignore[arg-type]
        if kind == "zip":
            return IO.read_zip(self.spark, path, c.get("encoding"))  # type: ignore[arg-type]
        if kind == "fgb":
            return IO.read_fgb(self.spark, path, name)
        if kind == "kml":
            return IO.read_kml(self.spark, path, name)
        if kind == "gpkg":
            return IO.read_gpkg(self.spark, path, c.list("layers"))
        return {name: IO.read_parquet(self.spark, path, name=name, key=c.get("id-field"))}  # type: ignore[arg-type]

    def read_text(self, path: str, text: str, name: str, c: Command) -> dict[str, Layer]:
        """Content given as text: JSON, or delimited text."""
        if IO.file_type(path, text) in ("json", "ndjson"):
            if c.flag("ndjson") or path.endswith(".ndjson"):
                rows = self.spark.createDataFrame([(x,) for x in text.split("\n") if x.strip()], "j string")
                return IO.from_json_rows(rows, name)
            return IO.json_layers(self.spark.createDataFrame([(text,)], "value string"), c.get("json-path"), name)  # type: ignore[arg-type]
        import csv
        import io

        d = c.get("delimiter") or IO.guess_delimiter(text.split("\n", 1)[0])
        rows = list(csv.reader(io.StringIO(text.lstrip("﻿")), delimiter=str(d)))
        names = IO.unique_names([n.strip() for n in rows[0]]) if rows else []
        body = [tuple((r + [""] * len(names))[: len(names)]) for r in rows[1:] if r]
        df = self.spark.createDataFrame(body, ", ".join(f"`{n}` string" for n in names))
        types = dict(x.split(":") for x in c.list("field-types") or [])
        return {name: layer_of(IO.inferred(df, c.list("string-fields"), types, c.flag("decimal-comma")), name)}

    def do_i(self, c: Command) -> None:
        paths = c.values or c.list("files") or []
        if not paths:
            raise CommandError("-i needs a file")
        if "-" in paths and "-" not in self.inputs:
            self.inputs["-"] = sys.stdin.read()
        paths = [q for p in paths for q in (sorted(glob.glob(p)) or [p] if re.search(r"[*?\[]", p) and p not in self.inputs else [p])]
        got: dict[str, Layer] = {}
        for p in paths:
            for n, x in self.read(p, c).items():
                new, k = n, 2
                while new in got:  # files of the same name in several folders
                    new, k = f"{n}-{k}", k + 1
                got[new] = x
        if c.flag("merge-files") and len(got) > 1:
            merged = T.merge_layers(list(got.values()), force=True)
            got = {str(c.get("name") or "layer"): merged}
        self.targets = [self.put(x, n) for n, x in got.items()]

    def do_o(self, c: Command) -> None:
        """Adds each target to ``outputs``: the content by file name or, where the file has a path, the path it's at.

        Tables, JSON lines, records and features are written to a path as a folder of files, by all tasks, without a
        row on the driver (``single-file`` asks for one file); formats that are one file by nature go through it.
        """
        names = self.chosen(c)
        file = str(c.get("file") or "")
        form = str(c.get("format") or {"csv": "csv", "tsv": "csv", "txt": "csv", "json": "", "geojson": "geojson", "ndjson": "ndjson", "topojson": "topojson", "shp": "shapefile", "dbf": "dbf", "kml": "kml", "gpkg": "gpkg", "fgb": "flatgeobuf", "parquet": "geoparquet"}.get(Path(file).suffix.lstrip("."), ""))
        for name in names:
            x = self.layers[name]
            if c.flag("drop-table"):
                x = T.filter_fields(x, [])
            if c.flag("field-order"):
                x = T.filter_fields(x, sorted(x.fields, key=str.lower))
            if c.get("precision") and x.geometry_type:
                from geolathe.functions.geometry import rounded

                x = x.with_df(x.df.withColumn(GEOM, rounded(F.col(GEOM), c.number("precision") or 1.0, x.geometry_type == "point")))
            form_ = form or ("geojson" if x.geometry_type else "json")
            stem = Path(file).stem if file and len(names) == 1 else name
            if form_ in ("geoparquet", "parquet"):
                path = file or f"{stem}.parquet"
                IO.write_parquet(x, path, str(c.get("compression") or "snappy"), int(c.number("level")) if c.get("level") else None)  # type: ignore[arg-type]
                self.outputs[Path(path).name] = path
                continue
            if c.flag("cut-table") and x.geometry_type:
                self.outputs[f"{stem}-table.json"] = IO.content(x.with_df(x.df.drop(GEOM), geometry_type=None), "json")["json"]
                x = T.filter_fields(x, [])
            out = file if len(names) == 1 or not file else str(Path(file).with_name(f"{name}{Path(file).suffix}"))
            if "/" in file and not c.flag("single-file") and form_ in ("csv", "json", "ndjson", "geojson"):
                gzip = c.flag("gzip") or out.endswith(".gz")
                if form_ == "csv":
                    IO.write_csv(x, out, str(c.get("delimiter") or ("\t" if file.endswith(".tsv") else ",")), c.flag("decimal-comma"), gzip)
                elif c.flag("ndjson") or form_ == "ndjson":
                    IO.write_ndjson(x, out, form_ != "json", gzip)
                else:
                    IO.write_documents(x if form_ == "geojson" else x.with_df(x.df.drop(GEOM), geometry_type=None), out, rfc7946=c.flag("rfc7946"), id_field=c.get("id-field"), gzip=gzip)
                self.outputs[Path(out).name] = out
                continue
            options = dict(delimiter=c.get("delimiter") or ("\t" if file.endswith(".tsv") else None), decimal_comma=c.flag("decimal-comma"), rfc7946=c.flag("rfc7946"), id_field=c.get("id-field"), ndjson=c.flag("ndjson"), quantization=int(c.number("quantization")) if c.get("quantization") else None)  # type: ignore[arg-type]
            for ext, data in IO.content(x, form_, **options).items():
                whole = Path(file).suffix and len(names) == 1 and form_ not in ("shapefile",)
                out = file if whole else str(Path(file).with_name(f"{stem}.{ext}")) if "/" in file else f"{stem}.{ext}"
                self.outputs[Path(out).name] = data
                if "/" in out:
                    Path(out).write_bytes(data if isinstance(data, bytes) else data.encode())

    # --- layers ------------------------------------------------------------------------------------------------

    def do_target(self, c: Command) -> None:
        names = self.find(str(c.get("target") or "*"))
        kind = c.get("type")
        self.targets = [n for n in names if not kind or self.layers[n].geometry_type == kind]
        if c.get("name") and len(self.targets) == 1:
            self.targets = [self._renamed(self.targets[0], str(c.get("name")))]

    def _renamed(self, old: str, new: str) -> str:
        self.layers = {(new if n == old else n): (replace(x, name=new) if n == old else x) for n, x in self.layers.items()}
        return new

    def do_rename_layers(self, c: Command) -> None:
        new = c.list("names") or []
        names = self.chosen(c)
        if len(new) != len(names):
            raise CommandError("-rename-layers needs one name per layer")
        self.targets = [self._renamed(a, b) for a, b in zip(names, new)]

    def do_merge_layers(self, c: Command) -> None:
        names = self.chosen(c)
        layers = [self.layers[n] for n in names]
        merged = O.flatten(layers, c.flag("force")) if c.flag("flatten") else T.merge_layers(layers, c.flag("force"))
        for n in names:
            self.layers.pop(n)
        self.targets = [self.put(merged, str(c.get("name") or _common(names)))]

    def do_union(self, c: Command) -> None:
        names = self.chosen(c)
        made = O.union([self.layers[n] for n in names], c.list("fields"))
        if not c.flag("no-replace"):
            for n in names:
                self.layers.pop(n)
        self.targets = [self.put(made, str(c.get("name") or "union"))]

    def do_drop(self, c: Command) -> None:
        if not c.list("fields") and not c.flag("geometry") and not c.flag("holes"):
            for n in self.chosen(c):
                self.layers.pop(n)
            self.targets = list(self.layers)[-1:]
            return
        self.each_layer(c, lambda p, x, c: T.drop(x, c.list("fields"), c.flag("geometry"), c.flag("holes")))

    def do_join(self, c: Command) -> None:
        src = self.source(str(c.get("source")))
        for name in self.chosen(c):
            x = self.layers[name]
            o = J.JoinOptions(c.list("fields"), c.get("calc"), c.get("where"), str(c.get("prefix") or ""), c.flag("force"), c.flag("duplication"), c.list("sum-fields") or [], self.defs)  # type: ignore[arg-type]
            if c.get("fields") == "":
                o.fields = []
            if c.get("interpolate"):
                self.layers[name] = replace(J.interpolated(x, src, c.list("interpolate") or []), name=name)
                continue
            if c.get("keys"):
                keys = c.list("keys") or []
                if len(keys) != 2:
                    raise CommandError("keys= needs two fields")
                r = J.join_keys(x, src, (keys[0], keys[1]), o)
            else:
                pairs = J.spatial_matches(x, src, c.number("max-distance"), c.flag("point-method"), c.flag("planar"), c.flag("largest-overlap"), (c.number("min-overlap-pct") or 0.0) * (100 if str(c.get("min-overlap-pct")).endswith("%") else 1), c.number("min-overlap-area") or 0.0)
                r = J.join(x, src, pairs, o)
            self.layers[name] = replace(r.layer, name=name)
            if c.flag("unjoined") or c.get("unjoined"):
                self.put(src.with_df(r.unjoined), "unjoined")
            if c.flag("unmatched") or c.get("unmatched"):
                self.put(x.with_df(r.unmatched), "unmatched")
        self.targets = self.chosen(c)

    # --- aggregates and information ----------------------------------------------------------------------------

    def do_calc(self, c: Command) -> None:
        for name in self.chosen(c):
            x = self.layers[name]
            if c.flag("no-replace"):
                self.put(layer_of(T.calc_table(x, str(c.get("expression")), c.get("where"), self.defs)), str(c.get("name") or "info"))  # type: ignore[arg-type]
                continue
            got = T.calc(x, str(c.get("expression")), c.get("where"), self.defs)  # type: ignore[arg-type]
            for k, v in got.items():
                self.messages.append(f"[calc] {k} = {v}")
                if re.fullmatch(r"\w+", k):
                    self.defs[k] = v

    def do_info(self, c: Command) -> None:
        got = [T.info(self.layers[n]) for n in self.chosen(c)]
        self.messages.append(json.dumps(got, default=str))
        if c.get("save-to"):
            self.outputs[str(c.get("save-to"))] = json.dumps(got, default=str)
        if c.flag("no-replace"):
            rows = [(str(i["layer_name"]), i["geometry_type"], int(i["feature_count"])) for i in got]  # type: ignore[call-overload]
            self.put(layer_of(self.spark.createDataFrame(rows, "layer_name string, geometry_type string, feature_count bigint")), str(c.get("name") or "info"))

    def do_inspect(self, c: Command) -> None:
        for n in self.chosen(c):
            got = T.inspect(self.layers[n], str(c.get("expression")), self.defs)
            self.messages.append(json.dumps(got, default=str) if got else "no single feature matches")

    def do_print(self, c: Command) -> None:
        self.messages.append(" ".join(c.values))

    def do_comment(self, c: Command) -> None:
        """Nothing."""

    do_quiet = do_verbose = do_debug = do_comment

    def do_version(self, c: Command) -> None:
        self.messages.append(__version__)

    def do_help(self, c: Command) -> None:
        self.messages.append("commands: " + ", ".join(sorted({m[3:].replace("_", "-") for m in dir(self) if m.startswith("do_")} | set(PER_LAYER))))

    def do_projections(self, c: Command) -> None:
        self.messages.append(", ".join(PR.ALIASES))

    def do_colors(self, c: Command) -> None:
        self.messages.append(", ".join(CL.SCHEMES))

    def do_encodings(self, c: Command) -> None:
        import encodings

        self.messages.append(", ".join(sorted(set(encodings.aliases.aliases.values()))))

    def do_check_geometry(self, c: Command) -> None:
        for n in self.chosen(c):
            k = O.check_geometry(self.layers[n])
            self.messages.append(f"{n}: {k} intersections")
            if k and c.flag("strict"):
                raise LayerError(f"{n} has {k} intersections")

    # --- control -----------------------------------------------------------------------------------------------

    def test(self, expression: str, c: Command) -> bool:
        """A condition over the session: layer_exists(), file_exists(), the target's name, size, type, fields, and variables."""
        name = self.find(str(c.get("layer") or c.get("target")))[0] if c.get("layer") or c.get("target") else self.targets[-1] if self.targets else None
        x = self.layers.get(name) if name else None
        t = Translator({}, defs={**self.vars, **self.defs}, unknown_null=True)
        fields = x.fields if x else []

        def quick(v: object) -> Callable:
            return lambda: lit(v)

        t.this = {"name": quick(name), "type": quick(x.geometry_type if x else None), "data": quick(bool(fields))}
        if x:
            size = lambda: lit(x.df.count())
            t.this |= {"size": size, "empty": lambda: lit(x.df.isEmpty())}
            t.fields |= {k: lit(v) for k, v in (("name", name), ("type", x.geometry_type))}
            kinds = T.translator(x).fields

            def includes(args: list, _: Translator) -> Value:
                value = F.lit(args[1][1])
                return lit(not x.df.where(F.col(f"`{args[0][1]}`") == value).isEmpty())

            t.calls |= {
                "field_exists": lambda a, _: lit(a[0][1] in fields),
                "field_type": lambda a, _: lit(kinds[a[0][1]].kind if a[0][1] in kinds else None),
                "field_includes": includes,
            }
        t.calls |= {"layer_exists": lambda a, _: lit(a[0][1] in self.layers), "file_exists": lambda a, _: lit(a[0][1] in self.inputs or Path(a[0][1]).exists())}
        from geolathe.functions.expressions import truth

        return bool(self.spark.range(1).select(truth(t.column(expression))).first()[0])

    def do_stop(self, c: Command) -> None:
        self.stopped = True

    def do_ignore(self, c: Command) -> None:
        if c.flag("empty") and any(self.layers[n].df.isEmpty() for n in self.chosen(c)):
            self.stopped = True

    def do_vars(self, c: Command) -> None:
        self.vars |= settings(c.values)

    def do_defaults(self, c: Command) -> None:
        self.defaults |= settings(c.values)

    def do_define(self, c: Command) -> None:
        """Constants (computed once) and arrow functions (kept as macros)."""
        for node in parse_expression(" ".join(c.values)):
            if node[0] != "assign" or node[1][0] != "name":
                raise CommandError("-define needs assignments")
            if node[2][0] == "arrow":
                self.defs[node[1][1]] = node[2]
            else:
                self.defs[node[1][1]] = self.spark.range(1).select(Translator({}, defs=self.defs).value(node[2]).col).first()[0]

    def do_include(self, c: Command) -> None:
        """Definitions from a JSON file, functions as texts of arrow functions."""
        name = str(c.get("file"))
        given = json.loads(str(self.inputs[name]) if name in self.inputs else Path(name).read_text())
        for k, v in given.items():
            node = parse_expression(v)[0] if isinstance(v, str) and "=>" in v else None
            self.defs[k] = node if node else v

    def do_require(self, c: Command) -> None:
        """A Python module of commands: its ``COMMANDS`` are functions from a layer and options to a layer."""
        import importlib

        module = importlib.import_module(str(c.get("module")))
        self.external |= getattr(module, "COMMANDS", {})

    def do_run(self, c: Command) -> None:
        """Commands from a file, from the inputs, or given as text."""
        given = " ".join(c.values)
        if given in self.inputs:
            given = str(self.inputs[given])
        elif Path(given).exists():
            given = Path(given).read_text()
        self.run(given)

    def do_colorizer(self, c: Command) -> None:
        colour = CL.colorizer({"colors": c.list("colors") or [], "breaks": c.numbers("breaks"), "categories": c.list("categories"), "random": c.flag("random"), "other": c.get("other") or c.get("nodata") or "white", "nodata": c.get("nodata") or "white"})
        self.colorizers[str(c.get("name"))] = colour

    @property
    def colorizers(self) -> dict:
        return self.__dict__.setdefault("_colorizers", {})

    # --- constructors ------------------------------------------------------------------------------------------

    def _box(self, c: Command) -> list[float] | None:
        if c.numbers("bbox"):
            return c.numbers("bbox")
        return T.layer_bounds(self.layers[self.targets[-1]]) if self.targets else None

    def _add(self, c: Command, x: Layer) -> None:
        self.targets = [self.put(x, str(c.get("name") or x.name))]

    def do_point_grid(self, c: Command) -> None:
        grid = re.split("[,x]", str(c.get("grid") or ""))
        cols, rows = (int(grid[0]), int(grid[1])) if len(grid) == 2 else (int(c.number("cols") or 0), int(c.number("rows") or 0))
        self._add(c, P.point_grid(self.spark, self._box(c), cols or None, rows or None, c.number("interval")))

    def do_grid(self, c: Command) -> None:
        box = self._box(c)
        if box is None:
            raise CommandError("-grid needs a layer or bbox=")
        size = {k: c.number(k) for k in ("interval", "cols", "rows", "cells") if c.get(k)}
        for k in ("cols", "rows", "cells"):
            if k in size:
                size[k] = int(size[k])  # type: ignore[arg-type]
        self._add(c, P.polygon_grid(self.spark, box, str(c.get("type") or "hex"), **size))  # type: ignore[arg-type]

    def do_rectangle(self, c: Command) -> None:
        box = c.numbers("bbox") or T.layer_bounds(self.source(str(c.get("source"))) if c.get("source") else self.layers[self.targets[-1]])
        if box is None:
            raise CommandError("-rectangle needs bounds")
        d = c.number("offset") or 0.0
        self._add(c, P.rectangle(self.spark, [box[0] - d, box[1] - d, box[2] + d, box[3] + d]))

    def do_frame(self, c: Command) -> None:
        box = c.numbers("bbox") or T.layer_bounds(self.layers[self.chosen(c)[-1]])
        if box is None:
            raise CommandError("-frame needs bounds")
        self._add(c, P.frame(self.spark, box, c.number("width"), c.number("height"), c.number("aspect-ratio"), c.number("offset") or 0.0))

    def do_scalebar(self, c: Command) -> None:
        """A row of what a map says about its scale: no geometry, drawn by whoever renders the map."""
        fields = {"type": "scalebar", **{k: str(v) for k, v in c.options.items() if k not in ("name", "target")}}
        self._add(c, layer_of(self.spark.createDataFrame([tuple(fields.values())], ", ".join(f"`{k}` string" for k in fields)), str(c.get("name") or "scalebar")))

    def do_graticule(self, c: Command) -> None:
        self._add(c, P.graticule(self.spark, c.number("interval") or 10.0))

    def do_add_shape(self, c: Command) -> None:
        """A feature from GeoJSON or coordinates, with properties."""
        if c.get("geojson"):
            g = json.loads(str(c.get("geojson")))
            props, geo = g.get("properties") or {}, g.get("geometry", g)
        else:
            v = c.numbers("coordinates") or []
            pts = [[a, b] for a, b in zip(v[::2], v[1::2])]
            props = json.loads(str(c.get("properties") or "{}"))
            geo = {"type": "Point", "coordinates": pts[0]} if len(pts) == 1 else {"type": "Polygon", "coordinates": [pts]} if pts[0] == pts[-1] else {"type": "LineString", "coordinates": pts}
        text = json.dumps({"type": "Feature", "properties": props, "geometry": geo})
        self._add(c, next(iter(IO.from_json_rows(self.spark.createDataFrame([(text,)], "j string"), "shape").values())))

    do_shape = do_add_shape


def _common(names: list[str]) -> str:
    """What the names of merged layers begin with."""
    first, last = min(names), max(names)
    n = next((i for i, (a, b) in enumerate(zip(first, last)) if a != b), min(len(first), len(last)))
    return first[:n].rstrip("-_ ") or names[0]


# --- commands on one layer -----------------------------------------------------------------------------------------


def _expr(c: Command) -> str:
    return str(c.get("expression"))


def _ids(c: Command) -> list[int] | None:
    return [int(v) for v in c.list("ids") or []] if c.get("ids") is not None else None


def _each(p: Pipeline, x: Layer, c: Command) -> Layer:
    if p.colorizers:
        return _each_coloured(p, x, c)
    return T.each(x, _expr(c), c.get("where"), _ids(c), p.defs)  # type: ignore[arg-type]


def _each_coloured(p: Pipeline, x: Layer, c: Command) -> Layer:
    """Assignments that call a colorizer, by its name; others as usual."""
    for node in parse_expression(_expr(c)):
        if node[0] == "assign" and node[2][0] == "call" and node[2][1][0] == "name" and node[2][1][1] in p.colorizers:
            value = T.translator(x, p.defs).value(node[2][2][0]).col
            x = x.with_df(x.df.withColumn(node[1][1], p.colorizers[node[2][1][1]](value)))
        else:
            x = T.each(x, _expr(c), c.get("where"), _ids(c), p.defs)  # type: ignore[arg-type]
            break
    return x


def _dissolve(p: Pipeline, x: Layer, c: Command) -> Layer:
    fields, calc, sums, copies, where = c.list("fields", "field"), c.get("calc"), c.list("sum-fields"), c.list("copy-fields"), c.get("where")
    if where and x.geometry_type:
        test = T.strict(x, str(where), p.defs)
        done = _dissolve(p, x.with_df(x.df.where(test)), Command(c.name, c.values, {k: v for k, v in c.options.items() if k != "where"}))
        return T.merge_layers([x.with_df(x.df.where(~test)), done], force=True)
    if x.geometry_type == "polygon":
        if not (c.flag("no-repair") or c.flag("multipart") or c.flag("allow-overlaps")):  # overlaps go to the first polygon, small gaps to a neighbour
            x = O.clean(x, c.number("gap-fill-area") or 0.0)
        elif c.flag("allow-overlaps"):
            return O.dissolve_overlapping(x, fields, calc, sums, copies, p.defs)  # type: ignore[arg-type]
        return TO.dissolve_polygons(x, fields, calc, sums, copies, c.flag("multipart"), p.defs)  # type: ignore[arg-type]
    if x.geometry_type == "point":
        return P.dissolve_points(x, fields, c.get("weight"), c.flag("planar"), calc, copies, c.flag("group-points") or c.flag("multipart"), p.defs)  # type: ignore[arg-type]
    if x.geometry_type == "polyline":
        return TO.dissolve_lines(x, fields, calc, p.defs)  # type: ignore[arg-type]
    return T.dissolve(x, fields, calc, sums, copies, where, p.defs)  # type: ignore[arg-type]


def _clip(erase: bool) -> Callable:
    def run(p: Pipeline, x: Layer, c: Command) -> Layer:
        box = c.numbers("bbox") or c.numbers("bbox2")
        if box:
            return P.clip_points(x, box, erase) if x.geometry_type == "point" else PA.clip_bbox(x, box, erase)
        return O.clip(x, p.source(str(c.get("source"))), erase)

    return run


def _points(p: Pipeline, x: Layer, c: Command) -> Layer:
    if c.get("x") or c.get("y") or not x.geometry_type:
        return P.points_from_fields(x, c.get("x"), c.get("y"))  # type: ignore[arg-type]
    for how in ("vertices", "vertices2"):
        if c.flag(how):
            return P.vertices(x, how == "vertices2")
    if c.flag("endpoints"):
        return P.endpoints(x)
    for how in ("midpoints", "interpolated"):
        if c.flag(how):
            return PA.line_points(x, how, c.number("interval"))
    if x.geometry_type == "polyline":
        return PA.line_points(x, "central")
    return PA.inner_point_layer(x) if c.flag("inner") else P.centroids(x)


def _fuzzy_join(p: Pipeline, x: Layer, c: Command) -> Layer:
    if c.flag("contiguous") or c.flag("postprocess"):
        raise CommandError("-fuzzy-join contiguous isn't built: groups would be weighed by the number of joined points")
    name = str(c.get("field"))
    return TO.data_fill(J.fuzzy_join(x, p.source(str(c.get("source"))), name, c.flag("no-dropouts")), name)


def _classify(p: Pipeline, x: Layer, c: Command) -> Layer:
    if c.flag("non-adjacent"):
        colours = c.list("colors")
        n = len(colours) if colours else int(c.number("classes") or 5)
        df = x.df.join(TO.coloured(x, n).withColumnRenamed("class", "_class"), FID, "left")
        value = F.get(F.array(*[F.lit(v) for v in colours]), F.col("_class")) if colours else F.col("_class")
        return x.with_df(df.withColumn(str(c.get("save-as") or ("fill" if colours else "class")), value).drop("_class"))
    if c.get("method") == "blacki":
        parts = CL.components(x.df.select(FID, F.col(f"`{c.get('field')}`").alias("_m")), FID, "_m")
        return x.with_df(x.df.join(parts.withColumnRenamed("component", str(c.get("save-as") or "class")), FID, "left"))
    o: dict[str, object] = {}
    for k in ("breaks", "outer-breaks"):
        if c.get(k):
            o[k] = c.numbers(k)
    for k in ("categories", "colors"):
        if c.get(k):
            o[k] = c.list(k)
    if c.get("values"):
        vals = c.list("values") or []
        o["values"] = [float(v) for v in vals] if all(re.fullmatch(r"-?[\d.]+", v) for v in vals) else vals
    for k in ("method", "color-scheme", "null-value", "other", "index-field"):
        if c.get(k):
            o[k] = c.get(k)
    for k in ("quantile", "equal-interval", "hybrid", "nice", "continuous", "invert"):
        if c.flag(k):
            o[k] = True
    if c.get("classes"):
        o["classes"] = int(c.number("classes") or 4)
    if c.get("precision"):
        o["precision"] = c.number("precision")
    return CL.classify(x, str(c.get("field") or c.get("index-field")), c.get("save-as"), **o)  # type: ignore[arg-type]


def _lines(p: Pipeline, x: Layer, c: Command) -> Layer:
    if x.geometry_type == "point":
        return PA.lines_from_points(x, c.get("groupby"))  # type: ignore[arg-type]
    if c.flag("segments"):
        return PA.segments(x)
    return TO.lines(x, c.list("fields")) if x.geometry_type == "polygon" else x


def _simplify(p: Pipeline, x: Layer, c: Command) -> Layer:
    pct = c.get("percentage")
    share = None
    if pct is not None:
        text = str(pct)
        share = float(text.rstrip("%")) / 100 if text.endswith("%") else float(text)
    method = "dp" if c.flag("dp") else "visvalingam" if c.flag("visvalingam") else str(c.get("method") or "weighted")
    return PA.simplify(x, share, c.number("interval"), c.number("resolution"), method, c.number("weighting", 0.7) or 0.0, c.flag("planar"), c.flag("keep-shapes"))


def _buffer(p: Pipeline, x: Layer, c: Command) -> Layer:
    if x.geometry_type == "point":
        r = str(c.get("radius"))
        numeric = re.match(r"^[\d.]", r)
        return P.point_buffer(x, c.number("radius") if numeric else r, int(c.number("vertices") or 72), p.defs)  # type: ignore[arg-type]
    return O.line_buffer(x, c.number("radius") or 0.0)


def _symbols(p: Pipeline, x: Layer, c: Command) -> Layer:
    def size(name: str, default: float) -> float | str:
        v = str(c.get(name) or default)
        return float(v) if re.fullmatch(r"-?[\d.]+", v) else v

    return P.symbols(x, str(c.get("type") or "circle"), size("radius", 5.0), int(c.number("sides") or 0) or None, size("rotation", 0.0), c.number("scale") or 1.0, int(c.number("points") or 5), c.number("point-ratio") or 0.5, p.defs)


def _proj(p: Pipeline, x: Layer, c: Command) -> Layer:
    """Coordinates in another system; layers without one count as degrees."""
    target = str(c.get("crs") or c.get("projection"))
    change = PR.between(str(c.get("from") or c.get("init") or x.crs or "wgs84"), target)
    if c.flag("densify"):
        x = PA.densify(x, c.number("interval") or 1.0, True) if x.geometry_type != "point" else x
    made = PA.moved(x, change)
    return made.with_df(made.df, crs="wgs84" if target.lower() in ("wgs84", "epsg:4326", "longlat") else target)


def _rotate(p: Pipeline, x: Layer, c: Command) -> Layer:
    """Turns the sphere by longitude and latitude (degrees)."""
    a = [math.radians(v) for v in [*(c.numbers("rotation") or [0.0]), 0.0, 0.0][:3]]
    sign = -1 if c.flag("invert") else 1

    def turn(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lng, lat = np.radians(x) + (a[0] if sign > 0 else 0.0), np.radians(y)
        v = [np.cos(lat) * np.cos(lng), np.cos(lat) * np.sin(lng), np.sin(lat)]
        ca, sa = math.cos(sign * a[1]), math.sin(sign * a[1])
        v = [v[0] * ca - v[2] * sa, v[1], v[0] * sa + v[2] * ca]
        out = np.arctan2(v[1], v[0]) - (a[0] if sign < 0 else 0.0)
        return (np.degrees(out) + 540) % 360 - 180, np.degrees(np.arcsin(np.clip(v[2], -1.0, 1.0)))

    return PA.moved(x, turn)


def _dots(p: Pipeline, x: Layer, c: Command) -> Layer:
    """Random points in polygons, one per ``per-dot`` units of each field; seeded by the feature, so repeatable."""
    from geolathe.functions.shapes import in_ring, nested, ring_area

    fields = c.list("fields") or []
    per = c.number("per-dot") or 1.0
    vals = [F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0)) for f in fields] or [F.lit(per)]
    counts = F.array(*[F.floor(v / per).cast("double") for v in vals])
    seeded = x.settled.withColumn("_n", F.array(F.array(F.concat(F.array(F.col(FID).cast("double")), counts))))

    def place(parts: list, n: list) -> list:
        fid, wanted = int(n[0][0][0]), n[0][0][1:]
        rng = random.Random(fid)
        flat = [q for r in parts for q in r]
        box = [min(q[0] for q in flat), min(q[1] for q in flat), max(q[0] for q in flat), max(q[1] for q in flat)]
        out: list = []
        if not sum(map(ring_area, parts)) > 0:  # no room for a point
            return out
        for k, m in enumerate(wanted):
            got = 0
            while got < m:
                q = [rng.uniform(box[0], box[2]), rng.uniform(box[1], box[3])]
                if any(in_ring(*q, g[0]) and not any(in_ring(*q, h) for h in g[1:]) for g in nested(parts)):
                    out.append([q[0], q[1], float(k)])
                    got += 1
        return out

    dots = seeded.withColumn("_d", F.explode(PA.kernel(place, PA.POINT)(F.col(GEOM), F.col("_n"))))
    keep = c.list("copy-fields") or []
    label = F.get(F.array(*[F.lit(f) for f in fields]), F.col("_d")[2].cast("int")).alias("field") if fields else F.lit(None).cast("string").alias("field")
    from geolathe.layer import with_fid

    made = with_fid(dots.select(*[F.col(f"`{f}`") for f in keep], label, F.array(F.slice("_d", 1, 2)).alias(GEOM)))
    return x.with_df(made, geometry_type="point")


def _polygons(p: Pipeline, x: Layer, c: Command) -> Layer:
    """Polygons from lines: the faces that they bound, or (``from-rings``) lines that are closed."""
    from geolathe.functions.shapes import closed, faces, ring_area, split_segments

    if c.flag("from-rings"):
        return replace(PA.changed(x, lambda parts: [r if ring_area(r) > 0 else r[::-1] for r in parts if len(r) > 3 and r == closed(r)]), geometry_type="polygon")
    import numpy as np
    import pandas as pd

    segs = TO.edges(x).select("p", "q").distinct().withColumn("_all", F.lit(1))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.array([[v["x"], v["y"]] for v in pdf["p"]])
        b = np.array([[v["x"], v["y"]] for v in pdf["q"]])
        return pd.DataFrame({FID: range(len(f)), GEOM: f} if (f := faces(*split_segments(a, b))) else {FID: [], GEOM: []})

    made = segs.groupBy("_all").applyInPandas(run, f"{FID} bigint, {GEOM} array<array<array<double>>>")
    return x.with_df(made, geometry_type="polygon")


def _style(p: Pipeline, x: Layer, c: Command) -> Layer:
    """Style fields from constants or expressions over the fields."""
    df = x.df
    for k, v in c.options.items():
        if k in ("where", "target", "ids", "clear", "no-replace", "expression"):
            continue
        try:
            value = T.translator(x, p.defs).column(str(v)).col if re.search(r"[^\w#.%-]", str(v)) or str(v) in x.fields else F.lit(v)
        except ValueError:
            value = F.lit(v)
        if c.get("where"):
            old = F.col(f"`{k}`") if k in df.columns else F.lit(None)
            value = F.when(T.strict(x, str(c.get("where")), p.defs), value).otherwise(old)
        df = df.withColumn(k, value)
    return x.with_df(df)


def _affine(p: Pipeline, x: Layer, c: Command) -> Layer:
    shift = c.numbers("shift") or [0.0, 0.0]
    anchor = c.numbers("anchor")
    return P.affine(x, (shift[0], shift[1]), c.number("scale", 1.0) or 1.0, c.number("rotate", 0.0) or 0.0, (anchor[0], anchor[1]) if anchor else None, c.get("where"), p.defs)  # type: ignore[arg-type]


def _split_grid(p: Pipeline, x: Layer, c: Command) -> dict[str, Layer]:
    nums = [int(v) for v in str(c.get("cols")).split(",")] if "," in str(c.get("cols")) else [int(c.number("cols") or 1), int(c.number("rows") or 1)]
    named = T.split_on_grid(x, nums[0], nums[1])
    return T.split(x.with_df(named), "cell")


PER_LAYER: dict[str, Callable] = {
    "each": _each,
    "filter": lambda p, x, c: T.filter_rows(x, c.get("expression"), c.flag("invert"), _ids(c), c.numbers("bbox"), c.flag("remove-empty"), p.defs),
    "filter-fields": lambda p, x, c: T.filter_fields(x, c.list("fields") or [], c.flag("invert")),
    "rename-fields": lambda p, x, c: T.rename_fields(x, c.list("fields") or []),
    "sort": lambda p, x, c: T.sort(x, _expr(c), c.flag("descending"), p.defs),
    "uniq": lambda p, x, c: T.uniq(x, _expr(c), int(c.number("max-count") or 1), c.flag("index"), c.flag("invert"), p.defs),
    "split": lambda p, x, c: T.split(x, c.get("expression") or c.get("field"), _ids(c), p.defs),
    "split-on-grid": _split_grid,
    "subdivide": lambda p, x, c: T.split(x.with_df(T.subdivide(x, _expr(c), p.defs)), "cell"),
    "dissolve": _dissolve,
    "classify": _classify,
    "points": _points,
    "point-to-grid": lambda p, x, c: P.point_to_grid(x, c.number("interval"), c.number("radius"), c.get("calc"), defs=p.defs),
    "affine": _affine,
    "clip": _clip(False),
    "erase": _clip(True),
    "slice": lambda p, x, c: O.slice_by(x, p.source(str(c.get("source"))), c.get("id-field")),
    "inlay": lambda p, x, c: O.inlay(x, p.source(str(c.get("source")))),
    "divide": lambda p, x, c: O.divide(x, p.source(str(c.get("source"))), c.list("fields"), c.flag("force")),
    "mosaic": lambda p, x, c: O.mosaic(x, c.get("calc"), p.defs),
    "clean": lambda p, x, c: O.clean(x, c.number("gap-fill-area") or 0.0, c.flag("allow-overlaps")),
    "snap": lambda p, x, c: PA.snap(x, c.number("interval")),
    "explode": lambda p, x, c: PA.explode(x, c.flag("naive")),
    "lines": _lines,
    "innerlines": lambda p, x, c: TO.innerlines(x, c.get("where"), p.defs),
    "polygons": _polygons,
    "simplify": _simplify,
    "smooth": lambda p, x, c: PA.smooth(x, c.number("distance") or 1.0, c.flag("planar")),
    "densify": lambda p, x, c: PA.densify(x, c.number("interval") or 1.0, c.flag("planar")),
    "dashlines": lambda p, x, c: PA.dashlines(x, c.number("dash-length") or 1.0, c.number("gap-length") or 0.0, c.flag("scaled"), c.flag("planar"), c.get("where"), p.defs),
    "filter-geom": lambda p, x, c: T.filter_geom(x, c.numbers("bbox")),
    "filter-points": lambda p, x, c: TO.filter_points(x, c.number("group-interval")),
    "filter-islands": lambda p, x, c: PA.filter_islands(x, c.number("min-area") or 0.0, int(c.number("min-vertices") or 0), c.flag("remove-empty")),
    "filter-slivers": lambda p, x, c: PA.filter_slivers(x, c.number("min-area"), c.number("sliver-control", 1.0), c.flag("remove-empty")),
    "filter-detail": lambda p, x, c: PA.filter_detail(x, c.number("distance") or 1.0),
    "buffer": _buffer,
    "rectangles": lambda p, x, c: P.rectangles(x, c.number("offset") or 0.0),
    "data-fill": lambda p, x, c: TO.data_fill(x, str(c.get("field")), c.flag("contiguous") or c.flag("postprocess"), c.get("weight-field")),
    "cluster": lambda p, x, c: TO.cluster(x, c.number("pct"), c.number("max-width"), c.number("max-height"), c.number("max-area"), c.get("group-by")),
    "fuzzy-join": _fuzzy_join,
    "alpha-shapes": lambda p, x, c: TO.alpha_shapes(x, c.number("interval")),
    "proj": _proj,
    "rotate": _rotate,
    "dots": _dots,
    "style": _style,
    "symbols": _symbols,
}


def apply_commands(spark: SparkSession, commands: str, inputs: dict[str, object] | None = None) -> dict[str, object]:
    """Outputs by file name of commands over in-memory inputs."""
    return Pipeline(spark, inputs).run(commands).outputs
