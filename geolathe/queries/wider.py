"""Further queries for the commands of the engine, each with SQL that gives the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolathe.functions import geometry as G
from geolathe.layer import FID, GEOM, Layer
from geolathe.operators import classify as CL
from geolathe.operators import joins as J
from geolathe.operators import overlay as O
from geolathe.operators import paths as PA
from geolathe.operators import points as P
from geolathe.operators import table as T
from geolathe.operators import topology as TO
from geolathe.plans.pipeline import Pipeline
from geolathe.queries import problems
from geolathe.queries.reference import BOXES, CUSTOMER_XY, EDGES, QUERIES, SHIFTED, SQL, Query, _folder, _ranked, boxes, commands, customer_points, layer, out, precinct_layer
from geolathe.session import table
from geolathe.sources import io as IO

OWN: list[str] = []


def query(sql: str | None = None):  # noqa: ANN201
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        OWN.append(f.__name__)
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def run(spark: SparkSession, inputs: dict[str, object], text: str) -> Layer:
    return Pipeline(spark, inputs).run(text).layer()


# --- files ---------------------------------------------------------------------------------------------------------


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_brand FROM part WHERE p_size > 20")
def csv_fields_and_filter(spark: SparkSession, root: str) -> DataFrame:
    path = _folder(spark, "csv")
    return out(run(spark, {"part.parquet": layer(spark, root, "part")}, f"-i part.parquet -o {path}/p.csv -i {path}/p.csv csv-fields=p_partkey,p_brand csv-filter='p_size > 20' string-fields=p_partkey"))


@query("SELECT least(1234, count(*)) AS n FROM orders")
def csv_lines_limit(spark: SparkSession, root: str) -> DataFrame:
    path = _folder(spark, "csv")
    x = run(spark, {"o.parquet": layer(spark, root, "orders")}, f"-i o.parquet -o {path}/o.csv -i {path}/o.csv csv-lines=1234")
    return x.df.agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(s_suppkey AS DOUBLE) AS s_suppkey, s_name, s_acctbal FROM supplier")
def csv_decimal_comma(spark: SparkSession, root: str) -> DataFrame:
    path = _folder(spark, "csv")
    return out(run(spark, {"s.parquet": layer(spark, root, "supplier")}, f"-i s.parquet -filter-fields s_suppkey,s_name,s_acctbal -o {path}/s.csv decimal-comma delimiter=; -i {path}/s.csv decimal-comma"))


@query("SELECT CAST(c_custkey AS DOUBLE) AS c_custkey, c_name || 'é' AS name FROM customer")
def csv_encoding(spark: SparkSession, root: str) -> DataFrame:
    path = _folder(spark, "csv")
    table(spark, root, "customer").select("c_custkey", F.concat("c_name", F.lit("é")).alias("name")).write.option("header", True).option("encoding", "ISO-8859-1").csv(f"{path}/c.csv")
    return out(run(spark, {}, f"-i {path}/c.csv encoding=ISO-8859-1"))


@query("SELECT CAST(s_suppkey AS DOUBLE) AS k, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer")
def merged_files(spark: SparkSession, root: str) -> DataFrame:
    path = _folder(spark, "csv")
    p = Pipeline(spark, {"s.parquet": layer(spark, root, "supplier"), "c.parquet": layer(spark, root, "customer")})
    p.run(f"-i s.parquet -filter-fields k=s_suppkey,name=s_name -o {path}/s.csv -i c.parquet -filter-fields k=c_custkey,name=c_name -o {path}/c.csv -i {path}/s.csv {path}/c.csv merge-files name=all")
    return out(p.layer())


@query("SELECT CAST(s_suppkey AS DOUBLE) AS id, s_name AS name, s_acctbal AS balance FROM supplier")
def fixed_width_text(spark: SparkSession, root: str) -> DataFrame:
    path = _folder(spark, "fixed")
    line = lambda a, b, c: F.concat(F.rpad(a, 10, " "), F.rpad(b, 30, " "), c)
    rows = table(spark, root, "supplier").select(line(F.col("s_suppkey").cast("string"), F.col("s_name"), F.col("s_acctbal").cast("string")).alias("value"))
    head = spark.range(1).select(line(F.lit("id"), F.lit("name"), F.lit("balance")).alias("value"))
    head.coalesce(1).unionByName(rows.coalesce(1)).coalesce(1).write.text(path)
    return out(IO.read_fixed_width(spark, path))


def _lead_back(spark: SparkSession, root: str, file: str, read: str = "") -> DataFrame:
    path = _folder(spark, "file")
    from pathlib import Path

    folder = Path(path.removeprefix("file:"))
    folder.mkdir(parents=True, exist_ok=True)
    x = run(spark, {"b.parquet": T.filter_fields(boxes(spark, root), ["key=n_nationkey", "n_name"])}, f"-i b.parquet -o {folder}/{file} -i {folder}/{read or file}")
    return x.settled.select(F.col("key").cast("int").alias("n_nationkey"), F.trim("n_name").alias("n_name"), F.round(G.area(F.col(GEOM)), 6).alias("area"))


NAMED_BOXES = f"SELECT n_nationkey, n_name, round((x1 - x0) * (y1 - y0), 6) AS area FROM ({BOXES}) JOIN nation USING (n_nationkey)"


@query(NAMED_BOXES)
def topojson_roundtrip(spark: SparkSession, root: str) -> DataFrame:
    return _lead_back(spark, root, "b.topojson")


@query(NAMED_BOXES)
def shapefile_roundtrip(spark: SparkSession, root: str) -> DataFrame:
    return _lead_back(spark, root, "b.shp")


@query(NAMED_BOXES)
def flatgeobuf_roundtrip(spark: SparkSession, root: str) -> DataFrame:
    return _lead_back(spark, root, "b.fgb")


@query(NAMED_BOXES)
def geopackage_roundtrip(spark: SparkSession, root: str) -> DataFrame:
    return _lead_back(spark, root, "b.gpkg")


@query("SELECT n_nationkey, n_name FROM nation")
def dbf_roundtrip(spark: SparkSession, root: str) -> DataFrame:
    from pathlib import Path

    folder = Path(_folder(spark, "dbf").removeprefix("file:"))
    folder.mkdir(parents=True, exist_ok=True)
    x = run(spark, {"n.parquet": layer(spark, root, "nation")}, f"-i n.parquet -filter-fields key=n_nationkey,n_name -o {folder}/n.dbf -i {folder}/n.dbf")
    return x.df.select(F.col("key").cast("int").alias("n_nationkey"), F.trim("n_name").alias("n_name"))


@query(f"SELECT round((x1 - x0) * (y1 - y0), 6) AS area FROM ({BOXES})")
def kml_roundtrip(spark: SparkSession, root: str) -> DataFrame:
    from pathlib import Path

    folder = Path(_folder(spark, "kml").removeprefix("file:"))
    folder.mkdir(parents=True, exist_ok=True)
    x = run(spark, {"b.parquet": boxes(spark, root)}, f"-i b.parquet -o {folder}/b.kml -i {folder}/b.kml")
    return x.settled.select(F.round(G.area(F.col(GEOM)), 6).alias("area"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def snapshot_roundtrip(spark: SparkSession, root: str) -> DataFrame:
    path = _folder(spark, "snapshot")
    IO.save_snapshot({"orders": T.filter_fields(layer(spark, root, "orders"), ["o_orderkey", "o_custkey", "o_totalprice"])}, path)
    return out(IO.load_snapshot(spark, path)["orders"])


# --- fields, rows, layers ------------------------------------------------------------------------------------------


@query("SELECT p_partkey, p_name, p_brand, p_type, p_retailprice, CAST(p_size AS DOUBLE) + 1 AS q FROM part")
def each_delete(spark: SparkSession, root: str) -> DataFrame:
    return commands(spark, root, ["part"], "-i part.parquet -each 'q = p_size + 1; delete this.properties.p_size'")


@query("SELECT CAST(o_orderkey AS DOUBLE) + 1 AS next, o_orderstatus AS status, NULL AS nothing FROM orders")
def each_replace_record(spark: SparkSession, root: str) -> DataFrame:
    return commands(spark, root, ["orders"], "-i orders.parquet -each 'this.properties = {next: o_orderkey + 1, status: o_orderstatus, nothing: null}'")


@query("SELECT p_partkey, CAST(len(string_split(p_type, ' ')) AS DOUBLE) AS n, lower(replace(p_type, ' ', '-')) AS u, string_split(p_type, ' ')[1] AS f, list_contains(string_split(p_type, ' '), 'TIN') AS t FROM part")
def array_functions(spark: SparkSession, root: str) -> DataFrame:
    df = commands(spark, root, ["part"], "-i part.parquet -each \"a = p_type.split(' '), n = a.length, u = a.map(x => x.toLowerCase()).join('-'), f = a[0], t = a.includes('TIN')\"")
    return df.select("p_partkey", "n", "u", "f", "t")


@query("SELECT event_id, CAST(year(ts) AS DOUBLE) AS y, CAST(month(ts) - 1 AS DOUBLE) AS m, CAST(day(ts) AS DOUBLE) AS d, CAST(hour(ts) AS DOUBLE) AS h, CAST(dayofweek(ts) AS DOUBLE) AS w FROM events")
def date_functions(spark: SparkSession, root: str) -> DataFrame:
    df = commands(spark, root, ["events"], "-i events.parquet -each 'y = ts.getFullYear(), m = ts.getMonth(), d = ts.getDate(), h = ts.getHours(), w = ts.getDay()'")
    return df.select("event_id", "y", "m", "d", "h", "w")


@query("SELECT p_partkey, round(CASE WHEN (p_size + 15) / 2.0 <= p_size THEN 10 * ((p_size + 15) / 2.0) / p_size WHEN (p_size + 15) / 2.0 <= p_size + 10 THEN 10 + 10 * ((p_size + 15) / 2.0 - p_size) / 10 ELSE 20 + 10 * ((p_size + 15) / 2.0 - p_size - 10) / 5 END, 6) AS m FROM part")
def interpolated_median(spark: SparkSession, root: str) -> DataFrame:
    df = commands(spark, root, ["part"], "-i part.parquet -each 'm = int_median([p_size, 10, 5], [0, 10, 20, 30])'")
    return df.select("p_partkey", F.round("m", 6).alias("m"))


@query("SELECT n_nationkey FROM nation WHERE n_nationkey % 3 <> 0")
def filter_remove_empty(spark: SparkSession, root: str) -> DataFrame:
    x = boxes(spark, root)
    x = x.with_df(x.df.withColumn(GEOM, F.when(F.col("n_nationkey") % 3 != 0, F.col(GEOM))))
    return run(spark, {"b.parquet": x}, "-i b.parquet -filter remove-empty").df.select("n_nationkey")


@query(f"SELECT n_nationkey FROM ({BOXES}) WHERE x0 <= 50 AND x1 >= -50 AND y0 <= 40 AND y1 >= -40")
def filter_bbox_polygons(spark: SparkSession, root: str) -> DataFrame:
    return run(spark, {"b.parquet": boxes(spark, root)}, "-i b.parquet -filter bbox=-50,-40,50,40").df.select("n_nationkey")


@query("SELECT n_nationkey, 1 AS parts FROM nation")
def filter_geom_parts(spark: SparkSession, root: str) -> DataFrame:
    x = boxes(spark, root)
    far = F.transform(F.col(GEOM)[0], lambda p: F.array(p[0] + 1000, p[1]))
    two = x.with_df(x.df.withColumn(GEOM, F.array(F.col(GEOM)[0], far)))
    return run(spark, {"b.parquet": two}, "-i b.parquet -filter-geom bbox=-200,-100,200,100").df.select("n_nationkey", F.size(GEOM).alias("parts"))


@query(f"SELECT n_nationkey, 1 AS parts, round((x1 - x0) * (y1 - y0), 6) AS area FROM ({BOXES})")
def filter_islands_small(spark: SparkSession, root: str) -> DataFrame:
    x = boxes(spark, root)
    tiny = F.transform(F.col(GEOM)[0], lambda p: F.array(p[0] * 0.01 + 1000, p[1] * 0.01))
    two = x.with_df(x.df.withColumn(GEOM, F.array(F.col(GEOM)[0], tiny)))
    got = run(spark, {"b.parquet": two}, "-i b.parquet -filter-islands min-area=10").settled
    return got.select("n_nationkey", F.size(GEOM).alias("parts"), F.round(G.area(F.col(GEOM)), 6).alias("area"))


@query(f"SELECT n_nationkey, x0 < 0 AND x1 > 0 AND y0 < 0 AND y1 > 0 AS around, x0 <= 50 AND x1 >= -50 AND y0 <= 40 AND y1 >= -40 AS meets, x0 >= -110 AND x1 <= 110 AND y0 >= -60 AND y1 <= 60 AS within, round(x1 - x0, 6) AS w, round(y1 - y0, 6) AS h, 1.0::DOUBLE AS parts FROM ({BOXES})")
def bbox_predicates(spark: SparkSession, root: str) -> DataFrame:
    x = run(spark, {"b.parquet": boxes(spark, root)}, "-i b.parquet -each 'around = this.bboxContainsPoint(0, 0), meets = this.bboxIntersectsRectangle(-50, -40, 50, 40), within = this.bboxContainedByRectangle(-110, -60, 110, 60), w = this.width, h = this.height, parts = this.partCount'")
    return x.df.select("n_nationkey", "around", "meets", "within", F.round("w", 6).alias("w"), F.round("h", 6).alias("h"), "parts")


@query(f"SELECT c_custkey, x + 1 AS px, y * 2 AS py FROM (SELECT c_custkey, {CUSTOMER_XY} FROM customer)")
def each_moves_points(spark: SparkSession, root: str) -> DataFrame:
    x = run(spark, {"c.parquet": customer_points(spark, root)}, "-i c.parquet -each 'this.x = x + 1; this.y = y * 2; px = this.x; py = this.y'")
    return x.df.select("c_custkey", "px", "py")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 2 = 1")
def layer_catalog(spark: SparkSession, root: str) -> DataFrame:
    return commands(spark, root, ["nation", "region", "supplier"], "-i region.parquet -i nation.parquet -i supplier.parquet -target region -drop -target 'n*' -rename-layers land -filter 'n_nationkey % 2 == 1' -target land -filter-fields n_nationkey,n_name")


@query("SELECT doc_id, coalesce(lang, 'null') AS layer_name FROM documents")
def split_layers(spark: SparkSession, root: str) -> DataFrame:
    """Every layer that a split makes, with its name."""
    parts = T.split(layer(spark, root, "documents"), "lang")
    return reduce(DataFrame.unionByName, [x.df.select("doc_id", F.lit(n).alias("layer_name")) for n, x in parts.items()])


@query("SELECT c_custkey, CAST(floor(c_acctbal / 100) AS DOUBLE) AS hundreds, c_acctbal > 5000 AS rich, 3.0::DOUBLE AS k, 'some' AS size FROM customer WHERE c_acctbal >= 100")
def variables_and_control(spark: SparkSession, root: str) -> DataFrame:
    text = "-i customer.parquet -vars low=100 -defaults low=7 -define 'per = 100, hundreds = x => Math.floor(x / per)' -run sub.txt -if 'this.size > 0 && layer_exists(\"customer\")' -each \"size = 'some'\" -elif 'true' -each \"size = 'other'\" -else -each \"size = 'none'\" -endif -include defs.json -each 'k = third(9), rich = c_acctbal > 5000' -stop -filter false"
    inputs: dict[str, object] = {"customer.parquet": layer(spark, root, "customer"), "sub.txt": "-filter 'c_acctbal >= {{low}}' -each 'hundreds = hundreds(c_acctbal)'", "defs.json": '{"third": "x => x / 3"}'}
    return run(spark, inputs, text).df.select("c_custkey", "hundreds", "rich", "k", "size")


@query("SELECT s_suppkey, s_acctbal * 2 AS s_acctbal FROM supplier")
def external_command(spark: SparkSession, root: str) -> DataFrame:
    double = lambda x, options: x.with_df(x.df.withColumn(options["field"], F.col(options["field"]) * float(options["by"])))
    p = Pipeline(spark, {"s.parquet": layer(spark, root, "supplier")}, {"times": double}).run("-i s.parquet -times field=s_acctbal by=2")
    return p.layer().df.select("s_suppkey", "s_acctbal")


# --- aggregates and classes ----------------------------------------------------------------------------------------


@query(f"SELECT c_mktsegment, max(x) - min(x) AS w, max(y) - min(y) AS h FROM (SELECT c_mktsegment, {CUSTOMER_XY} FROM customer) GROUP BY 1")
def calc_width_height(spark: SparkSession, root: str) -> DataFrame:
    return T.dissolve(customer_points(spark, root), ["c_mktsegment"], "w = width(), h = height()").df.select("c_mktsegment", "w", "h")


@query(f"SELECT c_mktsegment, round(degrees(atan2(sy, sx)), 6) AS lng, round(degrees(atan2(sz, sqrt(sx * sx + sy * sy))), 6) AS lat FROM (SELECT c_mktsegment, sum(cos(radians(y)) * cos(radians(x))) AS sx, sum(cos(radians(y)) * sin(radians(x))) AS sy, sum(sin(radians(y))) AS sz FROM (SELECT c_mktsegment, c_custkey, {CUSTOMER_XY} FROM customer) GROUP BY 1)")
def dissolve_points_sphere(spark: SparkSession, root: str) -> DataFrame:
    x = customer_points(spark, root)
    got = P.dissolve_points(x.with_df(x.df, crs="wgs84"), ["c_mktsegment"])
    g = F.col(GEOM)[0]
    return got.df.select("c_mktsegment", F.round(g[0], 6).alias("lng"), F.round(g[1], 6).alias("lat"))


@query(f"SELECT c_mktsegment, count(*) AS n, sum(x) AS sx FROM (SELECT c_mktsegment, {CUSTOMER_XY} FROM customer) GROUP BY 1")
def dissolve_group_points(spark: SparkSession, root: str) -> DataFrame:
    x = run(spark, {"c.parquet": customer_points(spark, root)}, "-i c.parquet -dissolve c_mktsegment group-points")
    return x.df.select("c_mktsegment", F.size(GEOM).cast("bigint").alias("n"), F.aggregate(GEOM, F.lit(0.0), lambda a, p: a + p[0]).alias("sx"))


@query(f"SELECT n_nationkey, round(2 * (x1 - x0) + 2 * (y1 - y0), 6) AS length FROM ({BOXES})")
def dissolve_lines_by_key(spark: SparkSession, root: str) -> DataFrame:
    x = run(spark, {"s.parquet": PA.segments(boxes(spark, root))}, "-i s.parquet -dissolve2 n_nationkey")
    return x.settled.select("n_nationkey", F.round(G.length(F.col(GEOM)), 6).alias("length"))


@query("SELECT p_partkey, c AS class FROM part JOIN (SELECT p_brand, CAST(row_number() OVER (ORDER BY min(p_partkey)) - 1 AS INTEGER) AS c FROM part GROUP BY p_brand) USING (p_brand)")
def classify_all_values(spark: SparkSession, root: str) -> DataFrame:
    return commands(spark, root, ["part"], "-i part.parquet -classify p_brand categories=* save-as=class").select("p_partkey", "class")


@query(f"WITH s AS (SELECT c_acctbal, row_number() OVER (ORDER BY c_acctbal) - 1 AS i FROM customer), b AS (SELECT {_ranked('c_acctbal', 'customer', 4)}) SELECT c_custkey, CAST(c_acctbal >= b1 AS INTEGER) + CAST(c_acctbal >= b2 AS INTEGER) + CAST(c_acctbal >= b3 AS INTEGER) AS class FROM customer, b")
def classify_default_method(spark: SparkSession, root: str) -> DataFrame:
    return commands(spark, root, ["customer"], "-i customer.parquet -classify c_acctbal").select("c_custkey", "class")


NICE = """
WITH s AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) - 1 AS i FROM orders WHERE o_totalprice IS NOT NULL),
q AS (SELECT (SELECT v FROM s WHERE i = (SELECT count(*) // 5 FROM s)) AS lo, (SELECT v FROM s WHERE i = (SELECT count(*) * 4 // 5 FROM s)) AS hi, (SELECT count(*) FROM s) AS n),
r AS (SELECT *, (hi - lo) / 3 AS span, pow(10, floor(log10((hi - lo) / 3)) - 1) AS k FROM q),
t AS (SELECT * FROM (VALUES (10, 10), (12, 2), (15, 5), (18, 2), (20, 10), (22, 2), (25, 5), (30, 10), (35, 5), (40, 10), (45, 5), (50, 50), (60, 10), (70, 10), (80, 10), (90, 10), (100, 10)) t(step, unit)),
c AS (SELECT r.*, step * k AS step, unit * k AS unit, CASE WHEN unit >= 50 THEN 1.0 WHEN unit >= 10 THEN 0.9 WHEN unit >= 5 THEN 0.8 ELSE 0.7 END AS w FROM r, t WHERE step = (SELECT max(step) FROM t WHERE step <= span / k AND step < 100) OR step = (SELECT min(step) FROM t WHERE step > (SELECT max(step) FROM t WHERE step <= span / k AND step < 100))),
d AS (SELECT *, floor(lo / unit + 0.5) * unit AS b FROM c),
e AS (SELECT *, b AS first FROM d UNION ALL SELECT *, CASE WHEN lo > b THEN b + unit ELSE b - unit END FROM d),
f AS (SELECT *, (SELECT count(*) FROM s WHERE v < first) AS a, (SELECT count(*) FROM s WHERE v >= first + 3 * step) AS z, n / 5.0 AS m FROM e),
g AS (SELECT *, w * ((CASE WHEN a > m THEN m / a ELSE m / (2 * m - a) END) + (CASE WHEN z > m THEN m / z ELSE m / (2 * m - z) END)) / 2 AS quality FROM f ORDER BY quality DESC LIMIT 1)
SELECT o_orderkey, CAST(o_totalprice >= first AS INTEGER) + CAST(o_totalprice >= first + step AS INTEGER) + CAST(o_totalprice >= first + 2 * step AS INTEGER) + CAST(o_totalprice >= first + 3 * step AS INTEGER) AS class FROM orders, g
"""


@query(NICE)
def classify_nice(spark: SparkSession, root: str) -> DataFrame:
    return CL.classify(layer(spark, root, "orders"), "o_totalprice", nice=True, classes=5).df.select("o_orderkey", "class")


# --- geometry ------------------------------------------------------------------------------------------------------


@query(f"{SHIFTED} SELECT n_nationkey, round((x1 - x0) * (y1 - y0) - coalesce((SELECT sum(s) FROM o WHERE i = n_nationkey), 0), 6) AS area FROM a UNION ALL SELECT k + 100, round((u1 - u0) * (v1 - v0), 6) FROM b")
def merge_flatten(spark: SparkSession, root: str) -> DataFrame:
    a = boxes(spark, root)
    b = P.affine(a, shift=(20.0, 10.0))
    b = b.with_df(b.df.withColumn("n_nationkey", F.col("n_nationkey") + 100))
    x = run(spark, {"a.parquet": a, "b.parquet": b}, "-i a.parquet -i b.parquet -merge-layers flatten target=a,b name=c")
    return x.settled.select("n_nationkey", F.round(G.area(F.col(GEOM)), 6).alias("area"))


@query(f"{SHIFTED} SELECT n_nationkey, round((x1 - x0) * (y1 - y0) - coalesce((SELECT sum(s) FROM o WHERE i = n_nationkey), 0), 6) AS area FROM a UNION ALL SELECT k + 100, round((u1 - u0) * (v1 - v0), 6) FROM b")
def inlay_polygons(spark: SparkSession, root: str) -> DataFrame:
    a = boxes(spark, root)
    b = P.affine(a, shift=(20.0, 10.0))
    b = b.with_df(b.df.withColumn("n_nationkey", F.col("n_nationkey") + 100))
    x = run(spark, {"a.parquet": a, "b.parquet": b}, "-i b.parquet -i a.parquet -inlay b")
    return x.settled.select("n_nationkey", F.round(G.area(F.col(GEOM)), 6).alias("area"))


@query(f"{SHIFTED} SELECT i AS n_nationkey, round(sum(s), 6) AS area FROM o GROUP BY 1")
def clip_polygons(spark: SparkSession, root: str) -> DataFrame:
    a = boxes(spark, root)
    x = run(spark, {"a.parquet": a, "b.parquet": P.affine(a, shift=(20.0, 10.0))}, "-i b.parquet -i a.parquet -clip b")
    return x.settled.select("n_nationkey", F.round(G.area(F.col(GEOM)), 6).alias("area"))


STRIPS = "SELECT r_regionkey, r_name, r_regionkey * 72.0 - 180 AS u0, r_regionkey * 72.0 - 108 AS u1 FROM region"


@query(f"SELECT r_name AS layer_name, n_nationkey, round((least(x1, u1) - greatest(x0, u0)) * (y1 - y0), 6) AS area FROM ({BOXES}), ({STRIPS}) WHERE x0 < u1 AND u0 < x1")
def slice_layers(spark: SparkSession, root: str) -> DataFrame:
    r = layer(spark, root, "region")
    u0 = F.col("r_regionkey") * 72.0 - 180
    ring = F.array(*[F.array(x, F.lit(y)) for x, y in ((u0, -90.0), (u0, 90.0), (u0 + 72, 90.0), (u0 + 72, -90.0), (u0, -90.0))])
    strips = r.with_df(r.df.withColumn(GEOM, F.array(ring)), geometry_type="polygon")
    parts = O.slice_by(boxes(spark, root), strips, "r_name")
    return reduce(DataFrame.unionByName, [x.settled.select(F.lit(n).alias("layer_name"), "n_nationkey", F.round(G.area(F.col(GEOM)), 6).alias("area")) for n, x in parts.items()])


LINES = "SELECT s_suppkey, CAST(s_suppkey * 7 % 180 - 90 + 0.25 AS DOUBLE) AS y FROM supplier"


def across(spark: SparkSession, root: str) -> Layer:
    """A line around the globe for each supplier, at a latitude that meets no side of a box."""
    x = layer(spark, root, "supplier")
    y = (F.col("s_suppkey") * 7 % 180 - 90 + 0.25).cast("double")
    return x.with_df(x.df.withColumn(GEOM, F.array(F.array(F.array(F.lit(-180.0), y), F.array(F.lit(180.0), y)))), geometry_type="polyline")


@query(f"WITH l AS ({LINES}), b AS ({BOXES}) SELECT s_suppkey, n_nationkey, 60.5::DOUBLE AS length FROM l JOIN b ON y BETWEEN y0 AND y1 UNION ALL SELECT s_suppkey, NULL, 360 - 60.5 * count(n_nationkey) FROM l LEFT JOIN b ON y BETWEEN y0 AND y1 GROUP BY 1")
def divide_lines(spark: SparkSession, root: str) -> DataFrame:
    x = run(spark, {"l.parquet": across(spark, root), "b.parquet": T.filter_fields(boxes(spark, root), ["n_nationkey"])}, "-i b.parquet -i l.parquet -divide b")
    return x.settled.groupBy("s_suppkey", "n_nationkey").agg(F.round(F.sum(G.length(F.col(GEOM))), 6).alias("length"))


@query(f"WITH l AS ({LINES}), b AS ({BOXES}) SELECT s_suppkey, n_nationkey AS nat FROM l LEFT JOIN b ON y BETWEEN y0 AND y1 AND 0 BETWEEN x0 AND x1")
def join_lines_polygons(spark: SparkSession, root: str) -> DataFrame:
    lines, b = across(spark, root), T.each(boxes(spark, root), "nat = n_nationkey")
    r = J.join(lines, b, J.spatial_matches(lines, b, point_method=True), J.JoinOptions(fields=["nat"]))
    return r.layer.df.select("s_suppkey", F.col("nat").cast("int").alias("nat"))


@query("SELECT n_nationkey, n_nationkey AS other FROM nation")
def join_polygons_by_point(spark: SparkSession, root: str) -> DataFrame:
    a = boxes(spark, root)
    b = T.each(P.affine(a, shift=(1.0, 1.0)), "other = n_nationkey")
    r = J.join(a, b, J.spatial_matches(a, b, point_method=True), J.JoinOptions(fields=["other"]))
    return r.layer.df.select("n_nationkey", F.col("other").cast("int").alias("other"))


INSIDE = problems._inside("precinct", "precincts", "precinct_id", "lng", "lat")


def site_points(spark: SparkSession, root: str) -> Layer:
    from geolathe.layer import points_of

    x = layer(spark, root, "sites")
    return points_of(x, "lng", "lat")


@query(f"SELECT site_id, precinct_code AS code FROM sites LEFT JOIN (SELECT id_lo, arg_min(precinct_code, precinct_id) AS precinct_code FROM ({INSIDE}) JOIN precincts ON precinct_id = id_hi GROUP BY 1) ON id_lo = site_id")
def join_sites_precincts(spark: SparkSession, root: str) -> DataFrame:
    """Points in polygons with holes, islands and slanted edges."""
    x = run(spark, {"s.parquet": site_points(spark, root), "p.parquet": T.rename_fields(precinct_layer(spark, root), ["code=precinct_code"])}, "-i p.parquet -i s.parquet -join p fields=code")
    return x.df.select("site_id", "code")


@query(f"SELECT precinct_code, CAST(count(id_lo) AS DOUBLE) AS n FROM precincts LEFT JOIN ({INSIDE}) ON precinct_id = id_hi GROUP BY 1")
def join_precincts_sites(spark: SparkSession, root: str) -> DataFrame:
    x = run(spark, {"s.parquet": site_points(spark, root), "p.parquet": precinct_layer(spark, root)}, "-i s.parquet -i p.parquet -join s calc='n = count()'")
    return x.df.select("precinct_code", "n")


PRECINCT_AREAS = f"WITH {EDGES} SELECT precinct_code, round(area, 6) AS area FROM f JOIN precincts ON precinct_id = id"


def _grid(spark: SparkSession, x: Layer, cells: int = 200) -> Layer:
    """Hexagons that cover a layer and more."""
    b = T.layer_bounds(x)
    assert b
    return P.polygon_grid(spark, [b[0] - 0.1, b[1] - 0.1, b[2] + 0.1, b[3] + 0.1], "hex", cells=cells)


@query(PRECINCT_AREAS)
def overlap_precincts_hexagons(spark: SparkSession, root: str) -> DataFrame:
    """What hexagons share with a precinct adds up to its area, holes left out."""
    x = precinct_layer(spark, root)
    got = O.overlap_areas(x, _grid(spark, x)).groupBy("_t").agg(F.round(F.sum("area"), 6).alias("area"))
    return x.df.join(got, x.df[FID] == got["_t"]).select("precinct_code", "area")


@query(PRECINCT_AREAS)
def clip_and_erase_precincts(spark: SparkSession, root: str) -> DataFrame:
    """What is inside of every other hexagon and what is outside add up to the precinct."""
    x = precinct_layer(spark, root)
    hexes = T.filter_rows(_grid(spark, x, 60), "col % 2 == 0")
    both = [O.clip(x, hexes, erase).settled.select("precinct_code", G.area(F.col(GEOM)).alias("a")) for erase in (False, True)]
    return both[0].unionByName(both[1]).groupBy("precinct_code").agg(F.round(F.sum("a"), 6).alias("area"))


@query(PRECINCT_AREAS)
def union_precincts_hexagons(spark: SparkSession, root: str) -> DataFrame:
    """The tiles of a union with hexagons add up to the precincts."""
    x = precinct_layer(spark, root)
    got = O.union([T.filter_fields(x, ["precinct_code"]), _grid(spark, x, 60)])
    return got.settled.where("precinct_code IS NOT NULL").groupBy("precinct_code").agg(F.round(F.sum(G.area(F.col(GEOM))), 6).alias("area"))


@query(f"WITH {EDGES} SELECT a, b, round(len, 6) AS length FROM l UNION ALL SELECT b, a, round(len, 6) FROM l")
def neighbours(spark: SparkSession, root: str) -> DataFrame:
    return TO.borders(precinct_layer(spark, root)).select("a", "b", F.round("length", 6).alias("length"))


@query(f"WITH {EDGES}, g AS (SELECT p, q, count(*) AS n FROM s GROUP BY ALL) SELECT CASE WHEN n = 1 THEN 'outer' ELSE 'inner' END AS type, round(sum(sqrt((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2)), 5) AS length FROM g GROUP BY 1")
def lines_outer_inner(spark: SparkSession, root: str) -> DataFrame:
    x = run(spark, {"p.parquet": precinct_layer(spark, root)}, "-i p.parquet -lines")
    return x.settled.select(F.col("TYPE").alias("type"), F.round(G.length(F.col(GEOM)), 5).alias("length"))


@query(f"SELECT count(*) AS n, round(sum((x1 - x0) * (y1 - y0)), 5) AS area FROM ({BOXES})")
def polygons_from_lines(spark: SparkSession, root: str) -> DataFrame:
    x = run(spark, {"s.parquet": PA.segments(boxes(spark, root))}, "-i s.parquet -polygons")
    return x.settled.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(G.area(F.col(GEOM))), 5).alias("area"))


@query("SELECT n_nationkey, n_nationkey % 7 AS dots FROM nation WHERE n_nationkey % 7 > 0")
def dots_in_polygons(spark: SparkSession, root: str) -> DataFrame:
    """As many dots as asked for, each inside of its polygon."""
    b = T.each(boxes(spark, root), "people = (n_nationkey % 7) * 10 + 5")
    x = run(spark, {"b.parquet": b}, "-i b.parquet -dots fields=people per-dot=10 copy-fields=n_nationkey")
    inside = J.point_in_polygon(x, b).withColumnRenamed("id", FID)
    own = x.df.join(inside, FID).join(b.df.select(F.col(FID).alias("region"), F.col("n_nationkey").alias("_own")), "region").where(F.col("n_nationkey") == F.col("_own"))
    return own.groupBy("n_nationkey").agg(F.count(F.lit(1)).cast("int").alias("dots"))


@query(f"SELECT c_custkey, round(((x + 90 + 540) % 360) - 180, 6) AS x, round(y, 6) AS y FROM (SELECT c_custkey, {CUSTOMER_XY} FROM customer) WHERE y > -90")
def rotate_points(spark: SparkSession, root: str) -> DataFrame:
    x = run(spark, {"c.parquet": customer_points(spark, root)}, "-i c.parquet -filter 'y > -90' -rotate 90")
    g = F.col(GEOM)[0]
    # the meridian at 180 degrees has two names
    lng = F.when(F.round(g[0], 6) == 180, F.lit(-180.0)).otherwise(F.round(g[0], 6))
    return x.settled.select("c_custkey", lng.alias("x"), F.round(g[1], 6).alias("y"))


@query(f"SELECT n_nationkey, CAST(i AS INTEGER) AS side, CASE i WHEN 0 THEN x0 WHEN 2 THEN x1 ELSE (x0 + x1) / 2 END AS x, CASE i WHEN 1 THEN y1 WHEN 3 THEN y0 ELSE (y0 + y1) / 2 END AS y FROM ({BOXES}), range(4) t(i)")
def points_midpoints(spark: SparkSession, root: str) -> DataFrame:
    x = run(spark, {"s.parquet": PA.segments(boxes(spark, root))}, "-i s.parquet -points midpoints")
    g = F.col(GEOM)[0]
    side = F.row_number().over(T.Window.partitionBy("n_nationkey").orderBy(FID)) - 1
    return x.settled.select("n_nationkey", side.alias("side"), g[0].alias("x"), g[1].alias("y"))


@query("SELECT n_nationkey, 2 AS n FROM nation, range(4)")
def points_endpoints(spark: SparkSession, root: str) -> DataFrame:
    return run(spark, {"s.parquet": PA.segments(boxes(spark, root))}, "-i s.parquet -points endpoints").df.select("n_nationkey", F.size(GEOM).alias("n"))


@query(f"SELECT n_nationkey, CAST(ceil((CASE WHEN i % 2 = 0 THEN 30.5 ELSE 60.5 END) / 7) + 1 AS INTEGER) AS n FROM ({BOXES}), range(4) t(i)")
def points_interpolated(spark: SparkSession, root: str) -> DataFrame:
    return run(spark, {"s.parquet": PA.segments(boxes(spark, root))}, "-i s.parquet -points interpolated interval=7").settled.select("n_nationkey", F.size(GEOM).alias("n"))


@query(f"SELECT n_nationkey, CAST(i AS INTEGER) AS side, round(2 * 2.5 * CASE WHEN i % 2 = 0 THEN 30.5 ELSE 60.5 END + 16 * 2.5 * 2.5 * sin(2 * pi() / 32), 5) AS area FROM ({BOXES}), range(4) t(i)")
def buffer_lines(spark: SparkSession, root: str) -> DataFrame:
    x = run(spark, {"s.parquet": PA.segments(boxes(spark, root))}, "-i s.parquet -buffer 2.5")
    side = F.row_number().over(T.Window.partitionBy("n_nationkey").orderBy(FID)) - 1
    return x.settled.select("n_nationkey", side.alias("side"), F.round(G.area(F.col(GEOM)), 5).alias("area"))


@query("SELECT count(*) AS n FROM nation")
def check_geometry(spark: SparkSession, root: str) -> DataFrame:
    """Boxes with two corners exchanged cross themselves once."""
    x = boxes(spark, root)
    r = F.col(GEOM)[0]
    bow = x.with_df(x.df.withColumn(GEOM, F.array(F.array(r[0], r[2], r[1], r[3], r[0]))))
    return spark.createDataFrame([(O.check_geometry(bow),)], "n bigint")


@query(f"SELECT n_nationkey, side, round(length, 6) AS length FROM (SELECT n_nationkey, CAST(i AS INTEGER) AS side, CASE i WHEN 0 THEN CASE WHEN x0 BETWEEN -50 AND 50 THEN least(y1, 40) - greatest(y0, -40) END WHEN 2 THEN CASE WHEN x1 BETWEEN -50 AND 50 THEN least(y1, 40) - greatest(y0, -40) END WHEN 1 THEN CASE WHEN y1 BETWEEN -40 AND 40 THEN least(x1, 50) - greatest(x0, -50) END ELSE CASE WHEN y0 BETWEEN -40 AND 40 THEN least(x1, 50) - greatest(x0, -50) END END AS length FROM ({BOXES}), range(4) t(i)) WHERE length > 0")
def clip_bbox_segments(spark: SparkSession, root: str) -> DataFrame:
    sides = PA.segments(boxes(spark, root))
    side = F.row_number().over(T.Window.partitionBy("n_nationkey").orderBy(FID)) - 1
    x = run(spark, {"s.parquet": sides.with_df(sides.df.withColumn("side", side))}, "-i s.parquet -clip bbox=-50,-40,50,40")
    return x.settled.select("n_nationkey", "side", F.round(G.length(F.col(GEOM)), 6).alias("length"))


@query("SELECT c_custkey, CAST(c_custkey * 1.5 AS DOUBLE) AS x, CAST(1 - c_custkey * 0.5 AS DOUBLE) AS y FROM customer")
def points_found_fields(spark: SparkSession, root: str) -> DataFrame:
    """Coordinate fields found by their usual names."""
    x = layer(spark, root, "customer")
    x = x.with_df(x.df.select(FID, "c_custkey", (F.col("c_custkey") * 1.5).cast("string").alias("Longitude"), (1 - F.col("c_custkey") * 0.5).alias("lat")))
    g = F.col(GEOM)[0]
    return run(spark, {"c.parquet": x}, "-i c.parquet -points").df.select("c_custkey", g[0].alias("x"), g[1].alias("y"))


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS total, CAST(count(*) OVER w AS DOUBLE) AS i FROM orders WINDOW w AS (ORDER BY o_orderkey)")
def each_running_total(spark: SparkSession, root: str) -> DataFrame:
    df = commands(spark, root, ["orders"], "-i orders.parquet -each 'global.t = (global.t || 0) + o_totalprice; total = global.t; i = global.n = (global.n || 0) + 1'")
    return df.select("o_orderkey", F.round("total", 2).alias("total"), "i")


FLAT = {"sinu": "radians(x) * cos(radians(y)) AS px, radians(y) AS py", "eqc": "radians(x) AS px, radians(y) AS py", "miller": "radians(x) AS px, 1.25 * ln(tan(pi() / 4 + 0.4 * radians(y))) AS py", "cea": "radians(x) AS px, sin(radians(y)) AS py"}


@query(" UNION ALL ".join(f"SELECT '{n}' AS proj, c_custkey, round(6378137.0 * px, 3) + 0.0 AS x, round(6378137.0 * py, 3) + 0.0 AS y FROM (SELECT c_custkey, {v} FROM (SELECT c_custkey, {CUSTOMER_XY} FROM customer))" for n, v in FLAT.items()))
def proj_straight_parallels(spark: SparkSession, root: str) -> DataFrame:
    g = F.col(GEOM)[0]
    made = {n: run(spark, {"c.parquet": customer_points(spark, root)}, f"-i c.parquet -proj {n}").settled for n in FLAT}
    return reduce(DataFrame.unionByName, [df.select(F.lit(n).alias("proj"), "c_custkey", (F.round(g[0], 3) + 0.0).alias("x"), (F.round(g[1], 3) + 0.0).alias("y")) for n, df in made.items()])


@query(f"SELECT n_nationkey + 100 * i AS n_nationkey, x0, y0, x1, y1 FROM ({BOXES}), range(2) t(i)")
def snap_vertices(spark: SparkSession, root: str) -> DataFrame:
    """Boxes and copies of them that are a little off: all vertices meet at those of the boxes."""
    a = boxes(spark, root)
    off = P.affine(a, shift=(0.0003, 0.0002))
    both = T.merge_layers([a, off.with_df(off.df.withColumn("n_nationkey", F.col("n_nationkey") + 100))])
    b = G.bounds(F.col(GEOM), False)
    return run(spark, {"b.parquet": both}, "-i b.parquet -snap 0.001").df.select("n_nationkey", b["xmin"].alias("x0"), b["ymin"].alias("y0"), b["xmax"].alias("x1"), b["ymax"].alias("y1"))


SHARED_CIRCLE = "CASE WHEN d >= 8 + q THEN 0 WHEN d <= 8 - q THEN pi() * q * q ELSE acos(least(1, greatest(-1, (d * d + 64 - q * q) / (d * 16)))) * 64 + acos(least(1, greatest(-1, (d * d + q * q - 64) / (d * 2 * q)))) * q * q - sqrt(greatest(0, (-d + 8 + q) * (d + 8 - q) * (d - 8 + q) * (d + 8 + q))) / 2 END"


@query(f"""
WITH p AS (SELECT c_acctbal, {CUSTOMER_XY} FROM customer), e AS (SELECT min(x) - 8 AS a, min(y) - 8 AS b, max(x) + 8 AS c, max(y) + 8 AS d, 10 * sqrt(1 / pi()) AS q FROM p),
n AS (SELECT *, ceil((c - a) / 10) AS nx, ceil((d - b) / 10) AS ny FROM e), g AS (SELECT nx, ny, q, (a + c) / 2 - nx * 5 AS x0, (b + d) / 2 - ny * 5 AS y0 FROM n),
i AS (SELECT p.*, g.*, unnest(range(CAST(greatest(0, floor((x - 8 - q - x0) / 10)) AS BIGINT), CAST(least(nx - 1, floor((x + 8 + q - x0) / 10)) AS BIGINT) + 1)) AS col FROM p, g),
j AS (SELECT *, unnest(range(CAST(greatest(0, floor((y - 8 - q - y0) / 10)) AS BIGINT), CAST(least(ny - 1, floor((y + 8 + q - y0) / 10)) AS BIGINT) + 1)) AS r FROM i),
k AS (SELECT *, greatest(1e-300, sqrt((x - x0 - (col + 0.5) * 10) ** 2 + (y - y0 - (r + 0.5) * 10) ** 2)) AS d FROM j),
w AS (SELECT CAST(r * nx + col AS BIGINT) AS id, c_acctbal, {SHARED_CIRCLE} / 100 AS w FROM k)
SELECT id, round(sum(w), 6) AS weight, CAST(count(*) AS DOUBLE) AS n, round(sum(c_acctbal), 2) AS bal FROM w WHERE w > 0 GROUP BY id HAVING sum(w) > 0.05
""")
def point_to_grid(spark: SparkSession, root: str) -> DataFrame:
    x = run(spark, {"c.parquet": customer_points(spark, root)}, "-i c.parquet -point-to-grid interval=10 radius=8 calc='n = count(), bal = sum(c_acctbal)'")
    return x.df.select("id", F.round("weight", 6).alias("weight"), "n", F.round("bal", 2).alias("bal"))


@query("SELECT 0::BIGINT AS n UNION ALL SELECT count(*) FROM nation")
def ignore_empty(spark: SparkSession, root: str) -> DataFrame:
    """Commands after -ignore empty don't run where a layer is empty, and do where it isn't."""
    kept = [run(spark, {"n.parquet": layer(spark, root, "nation")}, f"-i n.parquet -filter '{f}' -ignore empty -each 'seen = true'") for f in ("n_nationkey < 0", "n_nationkey >= 0")]
    return reduce(DataFrame.unionByName, [x.df.agg(F.count(F.lit(1) if "seen" in x.fields else F.lit(None)).alias("n")) for x in kept])


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = 7")
def inspect_feature(spark: SparkSession, root: str) -> DataFrame:
    p = Pipeline(spark, {"n.parquet": layer(spark, root, "nation")}).run("-i n.parquet -inspect 'n_nationkey == 7' -inspect 'n_nationkey > 7'")
    return spark.createDataFrame([(m,) for m in p.messages if m.startswith("{")], "m string").select(F.get_json_object("m", "$.n_nationkey").cast("int").alias("n_nationkey"), F.get_json_object("m", "$.n_name").alias("n_name"))


@query("SELECT 'square' AS name, 4.0::DOUBLE AS area UNION ALL SELECT 'frame', 200.0")
def added_shapes(spark: SparkSession, root: str) -> DataFrame:
    p = Pipeline(spark).run("-add-shape coordinates=0,0,0,2,2,2,2,0,0,0 name=square -rectangle bbox=0,0,20,10 name=frame")
    return reduce(DataFrame.unionByName, [p.layer(n).settled.select(F.lit(n).alias("name"), F.abs(G.area(F.col(GEOM))).alias("area")) for n in ("square", "frame")])


@query("SELECT p_partkey, CASE WHEN p_size < (SELECT min(p_size) + (max(p_size) - min(p_size)) / 2.0 FROM part) THEN '#ff0000' ELSE '#0000ff' END AS fill FROM part")
def classify_colours(spark: SparkSession, root: str) -> DataFrame:
    return commands(spark, root, ["part"], "-i part.parquet -classify p_size equal-interval classes=2 colors=#ff0000,#0000ff").select("p_partkey", "fill")


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'red' WHEN 'MACHINERY' THEN 'green' ELSE 'grey' END AS colour FROM customer")
def colorizer_categories(spark: SparkSession, root: str) -> DataFrame:
    return commands(spark, root, ["customer"], "-i customer.parquet -colorizer name=shade colors=red,green categories=BUILDING,MACHINERY other=grey -each 'colour = shade(c_mktsegment)' -filter-fields c_custkey,colour")


@query("SELECT c_mktsegment, CAST(count(*) AS INTEGER) AS vertices FROM customer GROUP BY 1")
def lines_from_points(spark: SparkSession, root: str) -> DataFrame:
    x = run(spark, {"c.parquet": customer_points(spark, root)}, "-i c.parquet -lines groupby=c_mktsegment")
    return x.df.select("c_mktsegment", F.size(F.col(GEOM)[0]).alias("vertices"))


@query(f"SELECT c_custkey, round(3 * pow(1 + c_custkey % 4, 2) * sin(pi() / 3), 6) AS hexagon, round(5 * 0.4 * 4 * sin(pi() / 5), 6) AS star, round(x, 6) AS x, round(y + 2, 6) AS top FROM (SELECT c_custkey, {CUSTOMER_XY} FROM customer)")
def symbols_around_points(spark: SparkSession, root: str) -> DataFrame:
    """Hexagons of several sizes and stars, as areas; the first corner of a star points up."""
    inputs = {"c.parquet": customer_points(spark, root)}
    a = run(spark, inputs, "-i c.parquet -symbols type=hexagon radius='1 + c_custkey % 4'").settled.select("c_custkey", F.round(G.area(F.col(GEOM)), 6).alias("hexagon"))
    tip = F.col(GEOM)[0][0]
    b = run(spark, inputs, "-i c.parquet -symbols type=star radius=2 points=5 point-ratio=0.4").settled.select("c_custkey", F.round(G.area(F.col(GEOM)), 6).alias("star"), F.round(tip[0], 6).alias("x"), F.round(tip[1], 6).alias("top"))
    return a.join(b, "c_custkey")


@query("SELECT 'frame' AS type, 1000.0::DOUBLE AS width, 500.0::DOUBLE AS height, 2.0::DOUBLE AS ratio, '20 km' AS label")
def frame_and_scalebar(spark: SparkSession, root: str) -> DataFrame:
    p = Pipeline(spark, {"b.parquet": boxes(spark, root)}).run("-i b.parquet -frame width=1000 aspect-ratio=2 name=frame -scalebar label='20 km'")
    b = G.bounds(F.col(GEOM), False)
    label = p.layer("scalebar").df.first()["label"]
    return p.layer("frame").df.select("type", "width", "height", F.round((b["xmax"] - b["xmin"]) / (b["ymax"] - b["ymin"]), 6).alias("ratio"), F.lit(label).alias("label"))


@query("SELECT c_custkey, c_custkey * 1.5::DOUBLE AS x, 2.0::DOUBLE AS r FROM customer")
def style_fields(spark: SparkSession, root: str) -> DataFrame:
    x = layer(spark, root, "customer")
    return run(spark, {"c.parquet": x}, "-i c.parquet -style x='c_custkey * 1.5' r='1 + 1'").df.select("c_custkey", "x", "r")


def queries() -> dict[str, Query]:
    return {n: QUERIES[n] for n in OWN}


def oracle_sql() -> dict[str, str]:
    return {n: SQL[n] for n in OWN if n in SQL}
