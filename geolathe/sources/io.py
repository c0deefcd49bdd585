"""Reading files into layers and writing layers to files.

Text and Parquet go through Spark's own sources, with projection, filters and limits applied by the optimizer. Formats
that Spark lacks are decoded file by file in executors; a file is the unit of parallel work there.
"""

from __future__ import annotations

import csv
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import replace
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geolathe.functions.expressions import Translator, Value, text
from geolathe.layer import FID, GEOM, Layer, LayerError, with_fid
from geolathe.operators.paths import ARROW, PATH, POINT
from geolathe.session import written
from geolathe.sources import flatgeobuf
from geolathe.sources import formats as fmt

#: Columns that hold no value in number columns of text files, besides the empty text.
NO_NUMBER = ["", "NA", "NaN"]
DELIMITERS = ["|", "\t", ",", ";"]


def file_type(path: str, head: str = "") -> str:
    """The format by extension, then by content."""
    ext = Path(path).suffix.lower().lstrip(".")
    known = {"csv": "csv", "tsv": "csv", "txt": "csv", "tab": "csv", "json": "json", "geojson": "json", "ndjson": "ndjson", "geojsonl": "ndjson", "topojson": "json", "shp": "shp", "dbf": "dbf", "parquet": "parquet", "geoparquet": "parquet", "gpkg": "gpkg", "kml": "kml", "zip": "zip", "kmz": "zip", "fgb": "fgb"}
    if ext == "gz":
        ext = Path(path).with_suffix("").suffix.lower().lstrip(".")
    if ext in known:
        return known[ext]
    start = head.lstrip()[:1]
    return "json" if start in ("{", "[") else "kml" if start == "<" else "csv"


# --- delimited text ------------------------------------------------------------------------------------------------


def guess_delimiter(line: str) -> str:
    return next((d for d in DELIMITERS if d in line), ",")


def unique_names(names: list[str]) -> list[str]:
    """Names made unique by numbers behind them."""
    out: list[str] = []
    for n in names:
        new, k = n, 1
        while new in out:
            new, k = f"{n}_{k}", k + 1
        out.append(new)
    return out


def number_of(c: Column, decimal_comma: bool = False) -> Column:
    """A cell as a number: thousands separators taken out, a decimal comma read as such; null where it's none."""
    t = F.trim(c)
    t = F.regexp_replace(F.regexp_replace(t, r"[. ]", ""), ",", ".") if decimal_comma else F.regexp_replace(t, r"(?<=\d),(?=\d{3})", "")
    return F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double"))


def inferred(df: DataFrame, string_fields: list[str] | None = None, field_types: dict[str, str] | None = None, decimal_comma: bool = False) -> DataFrame:
    """Columns of text as numbers where every cell that isn't empty is one (and some is): one aggregation pass.

    Cells that hold none become null there; in text columns missing cells are the empty text.
    """
    strings, types = set(string_fields or []), field_types or {}
    every = "*" in strings
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    asked = [n for n in names if not every and n not in strings and types.get(n, "") not in ("str", "string", "num", "number")]
    aggs = []
    for i, n in enumerate(asked):
        c = F.col(f"`{n}`")
        none = c.isNull() | F.trim(c).isin(NO_NUMBER)
        aggs += [F.count(F.when(~none & number_of(c, decimal_comma).isNull(), 1)).alias(f"b{i}"), F.count(F.when(~none, 1)).alias(f"v{i}")]
    r = df.agg(*aggs).first() if aggs else None
    numeric = {n for i, n in enumerate(asked) if r[f"b{i}"] == 0 and r[f"v{i}"] > 0} | {n for n in names if types.get(n, "") in ("num", "number")}
    return df.select(*[(number_of(F.col(f"`{f}`"), decimal_comma) if f in numeric else F.coalesce(F.col(f"`{f}`"), F.lit("")) if f in names else F.col(f"`{f}`")).alias(f) for f in df.columns])


def without_first(lines: DataFrame, n: int) -> DataFrame:
    """The lines of text files (``value``) without the first ``n`` of each file.

    These lie in a file's first block. Where that begins among the rows is found by one pass over the blocks at the
    beginning of files; the result has a row per file, no more than the driver lists for the scan.
    """
    if not n:
        return lines.select("value")
    rows = lines.select("value", F.col("_metadata.file_path").alias("_file"), (F.col("_metadata.file_block_start") == 0).alias("_head"), F.monotonically_increasing_id().alias("_at"))
    first = rows.where("_head").groupBy("_file").agg(F.min("_at").alias("_first"))
    kept = rows.join(F.broadcast(first), "_file", "left").where(~F.col("_head") | (F.col("_at") - F.col("_first") >= n))
    return kept.select("value")


def read_csv(spark: SparkSession, paths: str | list[str], delimiter: str | None = None, encoding: str = "UTF-8", skip_lines: int = 0, lines: int | None = None, field_names: list[str] | None = None, fields: list[str] | None = None, where: str | None = None, string_fields: list[str] | None = None, field_types: dict[str, str] | None = None, decimal_comma: bool = False, multiline: bool = False, name: str = "") -> Layer:
    """A table from delimited text with a header. Everything is read as text first; types are decided by the data.

    ``fields`` and ``lines`` are a projection and a limit; ``where`` filters rows by an expression over the texts.
    Quoted cells may hold delimiters; with ``multiline`` also line breaks (a file is then read by one task).
    """
    paths = [paths] if isinstance(paths, str) else paths
    head = [r[0] for r in spark.read.option("encoding", encoding).text(paths[0]).limit(skip_lines + 1).collect()]
    if len(head) <= skip_lines:
        return Layer(with_fid(spark.createDataFrame([], "`value` string").drop("value")), name)
    header = head[skip_lines].lstrip("﻿")
    d = delimiter or guess_delimiter(header)
    names = field_names or [n.strip() for n in next(csv.reader([header], delimiter=d))]
    names = unique_names([n or f"field{i + 1}" for i, n in enumerate(names)])
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    options = {"sep": d, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    if skip_lines or (field_names and not multiline):
        lines_ = without_first(spark.read.option("encoding", encoding).text(paths), skip_lines + (0 if field_names else 1))
        df = lines_.where(F.trim("value") != "").select(F.from_csv("value", ", ".join(f"`{n}` string" for n in names), options).alias("r")).select("r.*")
    else:
        df = spark.read.schema(schema).options(**options).option("encoding", encoding).option("multiLine", multiline).option("header", not field_names).csv(paths)
    if where:
        t = Translator.of(df.schema)
        df = df.where(F.coalesce(t.column(where).col, F.lit(False)))
    if lines is not None:
        df = df.limit(lines)
    if fields:
        missing = [f for f in fields if f not in df.columns]
        if missing:
            raise LayerError(f"no such columns: {', '.join(missing)}")
        df = df.select(*[F.col(f"`{f}`") for f in fields])
    return Layer(with_fid(inferred(df, string_fields, field_types, decimal_comma)), name or Path(paths[0]).stem)


def read_fixed_width(spark: SparkSession, path: str, name: str = "") -> Layer:
    """A table in columns of fixed width: a column begins where the header goes from blank to text and every line has
    a blank before. The last column goes to the end of the line."""
    rows = spark.read.text(path)
    head = rows.first()
    if head is None:
        return Layer(with_fid(rows.drop("value")), name or Path(path).stem)
    header = head[0]
    begins = [i for i in range(1, len(header)) if header[i] != " " and header[i - 1] == " "]
    taken = rows.agg(F.lit(True), *[F.max(~F.substring("value", i, 1).isin("", " ")).alias(f"t{i}") for i in begins]).first() if begins else {}
    starts = [0, *[i for i in begins if not taken[f"t{i}"]]]
    ends = [*starts[1:], None]
    names = unique_names([header[a:b].strip() for a, b in zip(starts, ends)])
    cells_ = [F.trim(F.substring("value", a + 1, b - a) if b is not None else F.expr(f"substring(value, {a + 1})")).alias(n) for n, a, b in zip(names, starts, ends)]
    df = with_fid(rows).where(F.col(FID) > 0)
    return Layer(with_fid(inferred(df.orderBy(FID).select(*cells_)), shuffled=True), name or Path(path).stem)


# --- JSON ----------------------------------------------------------------------------------------------------------


def read_json(spark: SparkSession, path: str, json_path: str | None = None, ndjson: bool = False, name: str = "") -> dict[str, Layer]:
    """Layers of a JSON file: records, GeoJSON or a topology. Several types of geometry give several layers."""
    name = name or Path(path).stem
    if ndjson:
        lines = spark.read.text(path).where(F.trim("value") != "")
        return from_json_rows(lines.select(F.col("value").alias("j")), name)
    whole = spark.read.text(path, wholetext=True)
    return json_layers(whole, json_path, name)


def json_layers(whole: DataFrame, json_path: str | None, name: str) -> dict[str, Layer]:
    """Layers of a DataFrame of whole JSON texts (column ``value``)."""
    value = F.regexp_replace("value", "^﻿", "")
    if json_path:
        value = F.get_json_object(value, "$." + json_path.replace("/", "."))
    whole = whole.select(value.alias("value"))
    kind = whole.select(F.get_json_object("value", "$.type")).first()[0]
    if kind == "Topology":
        return decoded(whole.select(F.lit("json").alias("ext"), F.encode("value", "UTF-8").alias("content")), lambda files: fmt.read_topojson(files["json"].decode()), name)
    listed = F.from_json(F.col("value"), "array<string>")
    if kind == "FeatureCollection":
        rows = whole.select(F.explode(F.from_json(F.get_json_object("value", "$.features"), "array<string>")).alias("j"))
    elif kind == "GeometryCollection":
        rows = whole.select(F.explode(F.from_json(F.get_json_object("value", "$.geometries"), "array<string>")).alias("j"))
    elif kind:
        rows = whole.select(F.col("value").alias("j"))
    else:
        rows = whole.select(F.explode(listed).alias("j"))
    return from_json_rows(rows, name)


def record_schema(texts: DataFrame) -> T.StructType:
    """The schema that covers all JSON objects of a column ``p``."""
    found = texts.sparkSession.read.json(texts.where(F.col("p").isNotNull()).rdd.map(lambda r: r[0]))
    return T.StructType([f for f in found.schema.fields if f.name != "_corrupt_record"])


PARTS = f"point {POINT}, polyline {PATH}, polygon {PATH}"
PARTS_ARROW = pa.struct([("point", ARROW[POINT]), ("polyline", ARROW[PATH]), ("polygon", ARROW[PATH])])


def geometry_parts(g: Column) -> Column:
    """Parts by layer type (a struct) from the JSON text of a geometry, Arrow batch by batch."""

    @F.arrow_udf(f"struct<{PARTS.replace(' array', ':array')}>")
    def parse(texts: pa.Array) -> pa.Array:
        return pa.array([fmt.from_geojson(json.loads(t)) if t is not None else None for t in texts.to_pylist()], type=PARTS_ARROW)

    return parse(g)


def from_json_rows(rows: DataFrame, name: str) -> dict[str, Layer]:
    """Layers of JSON objects ``j``: features, geometries or plain records. Ragged records get nulls."""
    kind = F.get_json_object("j", "$.type")
    geometries = ["Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon", "GeometryCollection"]
    spatial = (kind == "Feature") | kind.isin(geometries)
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(spatial, 1)).alias("s")).first()
    numbered = with_fid(rows)
    if not n["s"]:
        schema = record_schema(rows.select(F.col("j").alias("p")))
        df = numbered.select(FID, F.from_json("j", schema).alias("r"))
        return {name: Layer(df.select(FID, "r.*") if schema.fields else df.select(FID), name)}
    feature = kind == "Feature"
    df = numbered.select(FID, F.when(feature, F.get_json_object("j", "$.geometry")).otherwise(F.col("j")).alias("g"), F.when(feature, F.get_json_object("j", "$.properties")).alias("p"))
    schema = record_schema(df.select("p"))
    df = df.withColumn("r", F.from_json("p", schema)) if schema.fields else df.withColumn("r", F.lit(None))
    parts = ("point", "polyline", "polygon")
    df = df.withColumn("_parts", geometry_parts(F.col("g"))).withColumns({f"_{k}": F.col("_parts")[k] for k in parts})
    counts = df.agg(*[F.count(f"_{k}").alias(k) for k in parts]).first()
    kinds = [k for k in parts if counts[k]]
    fields = [F.col("r")[f.name].alias(f.name) for f in schema.fields]
    if not kinds:
        return {name: Layer(df.select(FID, *fields), name)}
    out = {}
    for i, k in enumerate(kinds):
        others = [F.col(f"_{o}").isNull() for o in kinds if o != k]
        keep = F.col(f"_{k}").isNotNull()
        if i == 0:  # features without geometry stay with the first layer
            rest = F.col(f"_{k}").isNull()
            for o in others:
                rest = rest & o
            keep = keep | rest
        layer = Layer(df.where(keep).select(FID, *fields, F.col(f"_{k}").alias(GEOM)), name if len(kinds) == 1 else f"{name}-{k}", k)
        out[layer.name] = layer
    return out


# --- formats decoded in executors ----------------------------------------------------------------------------------


def decoded(files: DataFrame, decode: Callable[[dict[str, bytes]], Iterator[fmt.Feature]], name: str) -> dict[str, Layer]:
    """Layers of files (columns ``ext``, ``content``, and ``stem`` where several files belong together)."""
    if "stem" not in files.columns:
        files = files.withColumn("stem", F.lit(name))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for exts, contents in zip(pdf["exts"], pdf["contents"]):
                rows = []
                for layer, kind, parts, props in decode({e: bytes(c) for e, c in zip(exts, contents)}):
                    rows.append((layer, kind, parts if kind == "point" else None, parts if kind and kind != "point" else None, json.dumps(props, default=str)))
                yield pd.DataFrame(rows, columns=["layer", "kind", "pt", "path", "p"])

    both = files.groupBy("stem").agg(F.collect_list(F.struct("ext", "content")).alias("f")).select(F.transform("f", lambda x: x["ext"]).alias("exts"), F.transform("f", lambda x: x["content"]).alias("contents"))
    df = with_fid(both.mapInPandas(run, f"layer string, kind string, pt {POINT}, path {PATH}, p string"), shuffled=True)
    df = written(df, "decoded")
    out: dict[str, Layer] = {}
    groups = df.groupBy("layer", "kind").agg(F.count(F.lit(1)).alias("n")).orderBy("layer", F.col("kind").asc_nulls_last()).collect()
    by_layer: dict[str, list] = {}
    for r in groups:
        by_layer.setdefault(r["layer"], []).append(r["kind"])
    for layer, kinds in by_layer.items():
        real = [k for k in kinds if k]
        for i, kind in enumerate(real or [None]):
            own = (F.col("kind") == kind) if kind else F.col("kind").isNull()
            rows = df.where((F.col("layer") == layer) & (own | F.col("kind").isNull() if i == 0 else own))
            schema = record_schema(rows.select("p"))
            fields = [F.from_json("p", schema)[f.name].alias(f.name) for f in schema.fields]
            geom = [(F.col("pt") if kind == "point" else F.col("path")).alias(GEOM)] if kind else []
            full = layer if len(real) < 2 else f"{layer}-{kind}"
            out[full] = Layer(rows.select(FID, *fields, *geom), full, kind)
    return out


def binary(spark: SparkSession, paths: list[str]) -> DataFrame:
    df = spark.read.format("binaryFile").load(paths)
    return df.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("stem"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("ext"), "content")


def sidecars(files: dict[str, bytes], encoding: str | None) -> str:
    """The encoding of a .dbf: as asked for, or what a .cpg beside it names."""
    import codecs

    named = files.get("cpg", b"").decode("ascii", "replace").strip()
    named = f"cp{named[4:].strip()}" if named.upper().startswith("ANSI") else f"cp{named}" if named.isdigit() and len(named) < 5 else named
    for name in (encoding, named):
        try:
            return codecs.lookup(name).name if name else ""
        except LookupError:
            continue
    return ""


def crs_of(prj: str) -> str | None:
    """The coordinate system that the text of a .prj describes, where it's one known by name; else the text itself."""
    flat = re.sub(r"\s+", "", prj)
    if not flat:
        return None
    if flat.upper().startswith("GEOGCS") and re.search(r"WGS_?(19)?84", flat, re.I):
        return "wgs84"
    if re.search(r"Mercator_Auxiliary_Sphere|Popular_Visualisation", flat, re.I):
        return "webmercator"
    zone = re.search(r"UTM_?[Zz]one_?(\d+)([NS])", flat, re.I)
    if zone and re.search(r"WGS_?(19)?84", flat, re.I):
        return f"+proj=utm +zone={zone.group(1)}{' +south' if zone.group(2).upper() == 'S' else ''}"
    return prj.strip()


def _shapes(label: str, encoding: str | None) -> Callable[[dict[str, bytes]], Iterator[fmt.Feature]]:
    def decode(files: dict[str, bytes]) -> Iterator[fmt.Feature]:
        kind, shapes = fmt.read_shp(files["shp"]) if "shp" in files else (None, [])
        rows = fmt.read_dbf(files["dbf"], sidecars(files, encoding) or "utf-8") if "dbf" in files else [{} for _ in shapes]
        for i, props in enumerate(rows):
            parts = fmt.shp_parts(kind, shapes[i]) if i < len(shapes) else None
            yield label, kind, parts, props

    return decode


def read_shapefile(spark: SparkSession, path: str, encoding: str | None = None, name: str = "") -> dict[str, Layer]:
    """A .shp with the .dbf, .cpg (encoding) and .prj (coordinate system) beside it, as far as there are, or a .dbf."""
    stem = re.sub(r"\.(shp|dbf)$", "", path, flags=re.I)
    local = [Path((stem + e).removeprefix("file:")) for e in (".shp", ".dbf", ".cpg", ".prj", ".SHP", ".DBF", ".CPG", ".PRJ")]
    present = list(dict.fromkeys([str(p) for p in local if p.exists()])) or [path]
    if path.lower().endswith(".dbf"):
        present = [p for p in present if p.lower().endswith((".dbf", ".cpg"))] or [path]
    label = name or Path(stem).name
    out = decoded(binary(spark, present), _shapes(label, encoding), label)
    prj = next((Path(p).read_text(errors="replace") for p in present if p.lower().endswith(".prj")), "")
    return {n: replace(x, crs=crs_of(prj) or x.crs) if x.geometry_type else x for n, x in out.items()}


def read_zip(spark: SparkSession, path: str, encoding: str | None = None) -> dict[str, Layer]:
    """The layers of the files in an archive (.zip, .kmz): unpacked by a task, then read by their types."""
    packed = spark.read.format("binaryFile").load(path).select("content")

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import zipfile

        for pdf in batches:
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                    names = [n for n in z.namelist() if not n.endswith("/") and not Path(n).name.startswith((".", "__MACOSX"))]
                    yield pd.DataFrame({"stem": [Path(n).stem for n in names], "ext": [Path(n).suffix.lower().lstrip(".") for n in names], "content": [z.read(n) for n in names]})

    files = written(packed.mapInPandas(unpack, "stem string, ext string, content binary"), "unpacked")
    out: dict[str, Layer] = {}
    held: dict[str, set] = {}
    for r in files.select("stem", "ext").collect():
        held.setdefault(r["stem"], set()).add(r["ext"])
    for stem, exts in sorted(held.items()):
        own = files.where(F.col("stem") == stem)
        if exts & {"shp", "dbf"}:
            got = decoded(own.where(F.col("ext").isin("shp", "dbf", "cpg", "prj")), _shapes(stem, encoding), stem)
            prj = own.where(F.col("ext") == "prj").first()
            out |= {n: replace(x, crs=crs_of(bytes(prj["content"]).decode("utf-8", "replace")) if prj else x.crs) for n, x in got.items()}
        for ext in sorted(exts):
            one = own.where(F.col("ext") == ext)
            text_ = one.select(F.decode("content", "UTF-8").alias("value"))
            if ext == "kml":
                out |= decoded(one, lambda files, stem=stem: ((stem, k, p, d) for _, k, p, d in fmt.read_kml(files["kml"].decode())), stem)
            elif ext == "fgb":
                out |= decoded(one, lambda files, stem=stem: flatgeobuf.read(files["fgb"], stem), stem)
            elif ext == "gpkg":
                out |= decoded(one, lambda files: fmt.read_gpkg(files["gpkg"], None), stem)
            elif ext in ("json", "geojson", "topojson"):
                out |= json_layers(text_, None, stem)
            elif ext in ("ndjson", "geojsonl"):
                out |= from_json_rows(text_.select(F.explode(F.split("value", r"\r?\n")).alias("j")).where(F.trim("j") != ""), stem)
            elif ext in ("csv", "tsv", "txt", "tab"):
                lines = text_.select(F.posexplode(F.split(F.regexp_replace("value", "^\ufeff", ""), r"\r?\n")).alias("i", "value")).where(F.trim("value") != "")
                header = lines.orderBy("i").first()["value"]
                d = guess_delimiter(header)
                names = unique_names([n.strip() or f"field{i + 1}" for i, n in enumerate(next(csv.reader([header], delimiter=d)))])
                rows = lines.where("i > 0").select(F.from_csv("value", ", ".join(f"`{n}` string" for n in names), {"sep": d, "quote": '"', "escape": '"'}).alias("r")).select("r.*")
                out[stem] = Layer(with_fid(inferred(rows)), stem)
    return out


def read_kml(spark: SparkSession, path: str, name: str = "") -> dict[str, Layer]:
    label = name or Path(path).stem
    return decoded(binary(spark, [path]), lambda files: ((label, k, p, d) for _, k, p, d in fmt.read_kml(files["kml"].decode())), label)


def read_fgb(spark: SparkSession, path: str, name: str = "") -> dict[str, Layer]:
    label = name or Path(path).stem
    return decoded(binary(spark, [path]), lambda files: flatgeobuf.read(files["fgb"], label), label)


def read_gpkg(spark: SparkSession, path: str, layers: list[str] | None = None) -> dict[str, Layer]:
    return decoded(binary(spark, [path]), lambda files: fmt.read_gpkg(files["gpkg"], layers), Path(path).stem)


# --- Parquet -------------------------------------------------------------------------------------------------------


@F.arrow_udf(T.StringType())
def _wkb_json(data: pa.Array) -> pa.Array:
    return pa.array([None if v is None else json.dumps(fmt.from_wkb(v)) for v in data.to_pylist()], type=pa.string())


def footer(spark: SparkSession, df: DataFrame, key: str) -> str | None:
    """What the footer of a table's first Parquet file says under a key, in whatever file system it lies."""
    files = sorted(df.inputFiles())
    if not files:
        return None
    jvm = spark._jvm
    where = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(files[0]), spark._jsc.hadoopConfiguration())
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(where)
    try:
        return reader.getFooter().getFileMetaData().getKeyValueMetaData().get(key)
    finally:
        reader.close()


def read_parquet(spark: SparkSession, path: str, geometry: str | None = None, name: str = "", key: str | None = None) -> Layer:
    """A table or, where a WKB column is named or described in the file's ``geo`` metadata, a layer with geometry."""
    df = spark.read.parquet(path)
    name = name or Path(path).stem
    if geometry is None:
        described = footer(spark, df, "geo")
        if described:
            geometry = json.loads(described).get("primary_column")
        elif "geometry" in df.columns and dict(df.dtypes)["geometry"] == "binary":
            geometry = "geometry"
    if not geometry:
        return Layer(df.select(F.col(key).cast("long").alias(FID), "*") if key else with_fid(df), name)
    numbered = df.select(F.col(key).cast("long").alias(FID), "*") if key else with_fid(df)
    parsed = numbered.withColumn("_j", F.from_json(_wkb_json(F.col(f"`{geometry}`")), PARTS)).drop(geometry)
    counts = parsed.agg(*[F.count(F.col("_j")[k]).alias(k) for k in ("polygon", "polyline", "point")]).first()
    kind = next((k for k in ("polygon", "polyline", "point") if counts[k]), None)
    if not kind:
        return Layer(parsed.drop("_j"), name)
    return Layer(parsed.withColumn(GEOM, F.col("_j")[kind]).drop("_j"), name, kind)


def with_wkb(layer: Layer, column: str = "geometry") -> DataFrame:
    kind = layer.geometry_type or "point"

    @F.arrow_udf("binary")
    def encode(g: pa.Array) -> pa.Array:
        return pa.array([None if not v else fmt.to_wkb(kind, v) for v in g.to_pylist()], type=pa.binary())

    return layer.settled.withColumn(column, encode(F.col(GEOM))).drop(GEOM)


def write_parquet(layer: Layer, path: str, compression: str = "snappy", level: int | None = None) -> None:
    """Parquet, geometry as WKB in ``geometry``; written by all tasks, in row order within each."""
    df = (with_wkb(layer) if layer.geometry_type else layer.df).drop(FID)
    writer = df.write.option("compression", compression)
    if level is not None:
        writer = writer.option("parquet.compression.codec.zstd.level", level)
    writer.mode("overwrite").parquet(path)


# --- text sinks ----------------------------------------------------------------------------------------------------


def cells(layer: Layer, decimal_comma: bool = False) -> list[Column]:
    """Fields as texts for a delimited file: null is empty, nested values are JSON, whole numbers have no point."""
    numbers = {f for f, t in layer.df.dtypes if decimal_comma and t in ("double", "float")}
    scope = Translator.of(T.StructType([f for f in layer.df.schema.fields if f.name in layer.fields]))
    plain = {f: F.when(F.col(f"`{f}`").isNull(), F.lit("")).otherwise(text(Value(F.col(f"`{f}`"), scope.fields[f].kind), "")) for f in layer.fields}
    return [(F.replace(c, F.lit("."), F.lit(",")) if f in numbers else c).alias(f) for f, c in plain.items()]


def csv_lines(layer: Layer, delimiter: str = ",", decimal_comma: bool = False) -> DataFrame:
    """(fid, line): cells are quoted only where they need it."""
    cols = cells(layer, decimal_comma)
    special = re.escape(delimiter) + r'"\r\n'
    quoted = [F.when(c.rlike(f"[{special}]"), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c) for c in cols]
    return layer.df.select(FID, F.concat_ws(delimiter, *quoted).alias("line"))


def write_csv(layer: Layer, path: str, delimiter: str = ",", decimal_comma: bool = False, gzip: bool = False) -> None:
    """A folder of delimited files, each with a header, in row order from file to file."""
    layer.df.orderBy(FID).select(*cells(layer, decimal_comma)).write.option("compression", "gzip" if gzip else "none").option("header", True).option("sep", delimiter).option("quote", '"').option("escape", '"').option("emptyValue", "").mode("overwrite").csv(path)


def feature_json(layer: Layer, rfc7946: bool = False, id_field: str | None = None) -> DataFrame:
    """(fid, j): a GeoJSON feature per row."""
    kind = layer.geometry_type

    @F.arrow_udf("string")
    def geometry(g: pa.Array) -> pa.Array:
        return pa.array([json.dumps(fmt.to_geojson(kind, v, rfc7946)) for v in g.to_pylist()], type=pa.string())

    props = F.to_json(F.struct(*[F.col(f"`{f}`") for f in layer.fields]), {"ignoreNullFields": "false"}) if layer.fields else F.lit("null")
    g = geometry(F.col(GEOM)) if kind else F.lit("null")
    head = F.concat(F.lit('{"type":"Feature","geometry":'), g, F.lit(',"properties":'), props)
    if id_field:
        head = F.concat(head, F.lit(',"id":'), F.regexp_replace(F.to_json(F.struct(F.col(f"`{id_field}`").alias("v")), {"ignoreNullFields": "false"}), r'^\{"v":|\}$', ""))
    return layer.settled.select(FID, F.concat(head, F.lit("}")).alias("j"))


def record_json(layer: Layer) -> DataFrame:
    return layer.df.select(FID, F.to_json(F.struct(*[F.col(f"`{f}`") for f in layer.fields]), {"ignoreNullFields": "false"}).alias("j"))


def write_ndjson(layer: Layer, path: str, features: bool = True, gzip: bool = False) -> None:
    """A folder of JSON lines: features, or records of a table."""
    rows = feature_json(layer) if layer.geometry_type and features else record_json(layer)
    rows.orderBy(FID).select("j").write.option("compression", "gzip" if gzip else "none").mode("overwrite").text(path)


def write_documents(layer: Layer, path: str, **options: object) -> None:
    """A folder of JSON files, each a document of its own: an array of records, or a GeoJSON collection of features."""
    rows, head, tail = record_json(layer), "[", "]"
    if layer.geometry_type:
        rows = feature_json(layer, bool(options.get("rfc7946")), options.get("id_field"))  # type: ignore[arg-type]
        head, tail = '{"type":"FeatureCollection", "features": [', "]}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for b in batches:
            texts = b.column("j").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([(head + "\n" if first and i == 0 else ",") + t for i, t in enumerate(texts)], pa.string())], ["value"])
            first = first and not texts
        yield pa.RecordBatch.from_arrays([pa.array([head + "\n" + tail if first else tail], pa.string())], ["value"])

    rows.orderBy(FID).select("j").mapInArrow(run, "value string").write.option("compression", "gzip" if options.get("gzip") else "none").mode("overwrite").text(path)


def rows_of(layer: Layer) -> Iterator[tuple[list | None, dict]]:
    """(parts, properties) in row order, fetched partition by partition: for formats that are one file by nature."""
    for r in layer.df.orderBy(FID).toLocalIterator(prefetchPartitions=True):
        d = r.asDict(recursive=True)
        d.pop(FID)
        yield d.pop(GEOM, None), d


def content(layer: Layer, kind: str, **options: object) -> dict[str, str | bytes]:
    """The content of the file or files of a layer, by extension."""
    name, geo = layer.name or "layer", layer.geometry_type
    if kind == "csv":
        d = str(options.get("delimiter") or ",")
        body = [r["line"] for r in csv_lines(layer, d, bool(options.get("decimal_comma"))).orderBy(FID).toLocalIterator()]
        head = d.join(f'"{f}"' if re.search(rf'[{re.escape(d)}"\n]', f) else f for f in layer.fields)
        return {"csv": "\n".join([head, *body])}
    if kind == "geojson" and geo:
        rows = [r["j"] for r in feature_json(layer, bool(options.get("rfc7946")), options.get("id_field")).orderBy(FID).toLocalIterator()]  # type: ignore[arg-type]
        return {"json": "\n".join(rows) if options.get("ndjson") else '{"type":"FeatureCollection", "features": [\n' + ",\n".join(rows) + "\n]}"}
    if kind in ("json", "geojson", "ndjson"):
        rows = [r["j"] for r in record_json(layer).orderBy(FID).toLocalIterator()]
        return {"json": "\n".join(rows) if options.get("ndjson") or kind == "ndjson" else "[\n" + ",\n".join(rows) + "\n]"}
    if kind == "topojson":
        return {"json": fmt.write_topojson({name: (geo or "point", list(rows_of(layer)))}, options.get("quantization"))}  # type: ignore[arg-type]
    if kind == "kml":
        return {"kml": fmt.write_kml(name, geo or "point", rows_of(layer))}
    if kind == "flatgeobuf":
        return {"fgb": flatgeobuf.write(name, geo or "point", rows_of(layer), layer.fields)}
    if kind == "gpkg":
        return {"gpkg": fmt.write_gpkg(name, geo or "point", rows_of(layer), layer.fields)}
    if kind in ("shapefile", "dbf"):
        rows = list(rows_of(layer))
        dbf = fmt.write_dbf([p for _, p in rows], layer.fields)
        if kind == "dbf" or not geo:
            return {"dbf": dbf}
        shp, shx = fmt.write_shp(geo, [g for g, _ in rows])
        return {"shp": shp, "shx": shx, "dbf": dbf}
    raise LayerError(f"unknown format {kind}")


def save_snapshot(layers: dict[str, Layer], path: str) -> None:
    """A session as a folder: a Parquet table per layer and a manifest."""
    spark = next(iter(layers.values())).df.sparkSession
    manifest = []
    for i, (name, x) in enumerate(layers.items()):
        x.df.write.mode("overwrite").parquet(f"{path}/layer{i}")
        manifest.append((name, x.geometry_type, x.crs, f"layer{i}"))
    spark.createDataFrame(manifest, "name string, geometry_type string, crs string, folder string").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def load_snapshot(spark: SparkSession, path: str) -> dict[str, Layer]:
    rows = spark.read.schema("name string, geometry_type string, crs string, folder string").json(f"{path}/manifest").collect()
    return {r["name"]: Layer(spark.read.parquet(f"{path}/{r['folder']}"), r["name"], r["geometry_type"], r["crs"]) for r in sorted(rows, key=lambda r: r["folder"])}
