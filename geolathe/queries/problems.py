"""The queries of the data-preparation operators in the core, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolathe.operators import impute, nested, proximity, rejects
from geolathe.session import table

Query = Callable[[SparkSession, str], DataFrame]

#: Distance in metres up to which two sites are near.
NEAR_M = 10.0


def _packets(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "feature_packets")


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return nested.flattened(_packets(spark, root), "packet_id", "body")


def p2_features(spark: SparkSession, root: str) -> DataFrame:
    return nested.features(_packets(spark, root), "packet_id", "body")


def p2_parts(spark: SparkSession, root: str) -> DataFrame:
    return nested.parts(_packets(spark, root), "packet_id", "body")


def p2_hu(spark: SparkSession, root: str) -> DataFrame:
    return nested.hu(_packets(spark, root), "packet_id", "body")


def p2_points(spark: SparkSession, root: str) -> DataFrame:
    return nested.points(_packets(spark, root), "packet_id", "body")


def p2_wui(spark: SparkSession, root: str) -> DataFrame:
    return nested.wui(_packets(spark, root), "packet_id", "body")


def p2_rev(spark: SparkSession, root: str) -> DataFrame:
    return nested.rev(_packets(spark, root), "packet_id", "body")


def _blocks(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "block_rows")


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return rejects.rejects(_blocks(spark, root), "raw_row", rejects.block_fields()).select("row_id")


def p3_rejects(spark: SparkSession, root: str) -> DataFrame:
    got = rejects.rejects(_blocks(spark, root), "raw_row", rejects.block_fields())
    return got.withColumn("reasons", F.array_join("reasons", ";"))


def p3_loaded(spark: SparkSession, root: str) -> DataFrame:
    return rejects.loaded(_blocks(spark, root), "raw_row", rejects.block_fields())


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    sites = table(spark, root, "sites")
    near = proximity.near_planar(sites, "site_id", "x_m", "y_m", NEAR_M).select(F.lit("near").alias("relation"), "id_lo", "id_hi")
    precinct = proximity.containing(sites, "site_id", "lng", "lat", table(spark, root, "precincts"), "precinct_id", "coordinates")
    county = proximity.containing(sites, "site_id", "x_m", "y_m", table(spark, root, "counties"), "county_id", "coordinates")
    within = [r.select(F.lit(n).alias("relation"), F.col("id").alias("id_lo"), F.col("region").alias("id_hi")) for n, r in (("precinct", precinct), ("county", county))]
    return near.unionByName(within[0]).unionByName(within[1])


def p4_near_counts(spark: SparkSession, root: str) -> DataFrame:
    return proximity.near_counts(table(spark, root, "sites"), "site_id", "x_m", "y_m", NEAR_M)


def p4_near_sphere(spark: SparkSession, root: str) -> DataFrame:
    return proximity.near_sphere(table(spark, root, "sites"), "site_id", "lng", "lat", NEAR_M)


def segment_fields() -> list[impute.Filled]:
    return [impute.Filled("county"), impute.Filled("district"), impute.Filled("district_no", "code", 1, 60)]


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return p5_fills(spark, root).select("seg_id", "field")


def p5_fills(spark: SparkSession, root: str) -> DataFrame:
    return impute.fills(table(spark, root, "precinct_segments"), "seg_id", "precinct_code", "edition", segment_fields())


def p5_filled(spark: SparkSession, root: str) -> DataFrame:
    return impute.filled_table(table(spark, root, "precinct_segments"), "seg_id", "precinct_code", "edition", segment_fields())


def p5_positions(spark: SparkSession, root: str) -> DataFrame:
    """Planar positions that sites lack, interpolated along the survey of their collector."""
    fields = [impute.Filled("x_m", "measure"), impute.Filled("y_m", "measure")]
    got = impute.fills(table(spark, root, "sites"), "site_id", "collector_code", "surveyed_at", fields)
    return got.select("site_id", "field", F.round(F.col("fill").cast("double"), 3).alias("fill"), "method", F.round("distance_days", 6).alias("distance_days"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p5_positions, p2_found, p2_features, p2_hu, p2_parts, p2_points, p2_wui, p2_rev, p3_found, p3_rejects, p3_loaded, p4_found, p4_near_counts, p4_near_sphere, p5_found, p5_fills, p5_filled)}


FIELD = r',("(?:[^"]|"")*"|[^",\r\n]*)'
NUMBER = r"[ \t]*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?[ \t]*"


def _number(x: str) -> str:
    return f"(regexp_full_match({x}, '{NUMBER}') AND abs(coalesce(try_cast(trim({x}) AS DOUBLE), 'inf'::DOUBLE)) < 'inf'::DOUBLE)"


P3_CUT = f"""
WITH t AS (SELECT *, ',' || regexp_replace(raw_row, '\\r$', '') AS r FROM block_rows),
c AS (SELECT *, regexp_full_match(r, '({FIELD})+') AS ok, [CASE WHEN starts_with(f, '"') THEN replace(f[2:-2], '""', '"') ELSE f END FOR f IN regexp_extract_all(r, '{FIELD}', 1)] AS v FROM t),
j AS (SELECT *, CASE WHEN raw_row IS NULL THEN ['missing'] WHEN NOT ok THEN ['quoting'] WHEN len(v) <> 11 THEN ['column_count'] ELSE list_filter([
 CASE WHEN v[1] <> 'Feature' THEN 'value:type' END,
 CASE WHEN NOT coalesce({_number('v[2]')} AND try_cast(trim(v[2]) AS DOUBLE) BETWEEN 1 AND 2147483647 AND try_cast(trim(v[2]) AS DOUBLE) = floor(try_cast(trim(v[2]) AS DOUBLE)), false) THEN 'value:OBJECTID' END,
 CASE WHEN NOT regexp_full_match(v[3], '[0-9]{{16}}') THEN 'value:PBG00' END, CASE WHEN NOT regexp_full_match(v[4], '[0-9]{{5}}') THEN 'value:FIPS_PBG' END,
 CASE WHEN v[5] NOT IN ('0', '1') THEN 'value:WATER00' END, CASE WHEN NOT (v[6] = '' OR {_number('v[6]')}) THEN 'value:HU2010ADJ' END, CASE WHEN NOT (v[7] = '' OR {_number('v[7]')}) THEN 'value:HDEN2010' END,
 CASE WHEN NOT (v[8] = '' OR coalesce({_number('v[8]')} AND try_cast(trim(v[8]) AS DOUBLE) BETWEEN 0 AND 100, false)) THEN 'value:VEG01PC' END,
 CASE WHEN trim(v[9]) = '' THEN 'value:WUICLASS' END, CASE WHEN NOT (v[11] = '' OR {_number('v[11]')}) THEN 'value:Shape_Area' END], lambda x: x IS NOT NULL) END AS reasons FROM c)
"""
P3 = f"{P3_CUT} SELECT row_id FROM j WHERE len(reasons) > 0"
P3_REJECTS = f"{P3_CUT} SELECT row_id, file_name, line_no, raw_row, array_to_string(reasons, ';') AS reasons FROM j WHERE len(reasons) > 0"
P3_LOADED = f"""
{P3_CUT} SELECT row_id, file_name, line_no, v[1] AS type, CAST(try_cast(trim(v[2]) AS DOUBLE) AS INTEGER) AS "OBJECTID", v[3] AS "PBG00", v[4] AS "FIPS_PBG", CAST(v[5] AS INTEGER) AS "WATER00",
 try_cast(trim(v[6]) AS DOUBLE) AS "HU2010ADJ", try_cast(trim(v[7]) AS DOUBLE) AS "HDEN2010", try_cast(trim(v[8]) AS DOUBLE) AS "VEG01PC", v[9] AS "WUICLASS", v[10] AS "NOTE", try_cast(trim(v[11]) AS DOUBLE) AS "Shape_Area"
FROM j WHERE len(reasons) = 0
"""

NEAR = """
WITH s AS (SELECT site_id AS id, x_m AS x, y_m AS y, CAST(floor(x_m / 10) AS BIGINT) AS cx, CAST(floor(y_m / 10) AS BIGINT) AS cy FROM sites WHERE x_m IS NOT NULL AND y_m IS NOT NULL),
v AS (SELECT id, x, y, cx + a.i AS cx, cy + b.i AS cy FROM s, (VALUES (-1), (0), (1)) a(i), (VALUES (-1), (0), (1)) b(i))
SELECT {columns} FROM s JOIN v ON s.cx = v.cx AND s.cy = v.cy AND {order} AND (s.x - v.x) * (s.x - v.x) + (s.y - v.y) * (s.y - v.y) <= 100.0
"""


def _inside(name: str, regions: str, region: str, x: str, y: str) -> str:
    """Even-odd test over the edges of each polygon, for points that share a strip of y with the edge."""
    return f"""
SELECT DISTINCT '{name}' AS relation, site_id AS id_lo, {region} AS id_hi FROM (
 SELECT s.site_id, e.{region}, e.p FROM sites s JOIN (
  SELECT {region}, p, ring[i][1] AS ax, ring[i][2] AS ay, ring[i % len(ring) + 1][1] AS bx, ring[i % len(ring) + 1][2] AS by
  FROM (SELECT {region}, p, ring, unnest(range(1, len(ring) + 1)) AS i FROM (
   SELECT {region}, p, unnest(coordinates[p]) AS ring FROM (SELECT {region}, coordinates, unnest(range(1, len(coordinates) + 1)) AS p FROM {regions})))
 ) e ON s.{y} >= least(e.ay, e.by) AND s.{y} < greatest(e.ay, e.by) AND s.{x} < e.ax + (s.{y} - e.ay) * (e.bx - e.ax) / (e.by - e.ay)
 WHERE s.{x} IS NOT NULL AND s.{y} IS NOT NULL
 GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1)
"""


P4 = " UNION ALL ".join(f"SELECT * FROM ({q})" for q in (
    NEAR.format(columns="'near' AS relation, s.id AS id_lo, v.id AS id_hi", order="s.id < v.id"),
    _inside("precinct", "precincts", "precinct_id", "lng", "lat"),
    _inside("county", "counties", "county_id", "x_m", "y_m"),
))

P4_COUNTS = f"""
WITH n AS ({NEAR.format(columns="s.id, count(*) AS n", order="s.id <> v.id")} GROUP BY s.id),
p AS (SELECT site_id, min(site_id) OVER (PARTITION BY x_m, y_m) AS place FROM sites WHERE x_m IS NOT NULL AND y_m IS NOT NULL)
SELECT p.site_id, p.place, coalesce(n.n, 0) AS n_near FROM p LEFT JOIN n ON p.site_id = n.id
"""

P4_SPHERE = """
WITH s AS (SELECT site_id AS id, lng AS x, lat AS y, CAST(floor(lat / 0.0002) AS BIGINT) AS cy FROM sites WHERE lng IS NOT NULL AND lat IS NOT NULL),
v AS (SELECT id, x, y, cy + b.i AS cy FROM s, (VALUES (-1), (0), (1)) b(i))
SELECT s.id AS id_lo, v.id AS id_hi FROM s JOIN v ON s.cy = v.cy AND s.id < v.id AND abs(s.x - v.x) < 0.001
WHERE 2 * 6378137.0 * asin(sqrt(pow(sin((radians(v.y) - radians(s.y)) / 2), 2) + cos(radians(s.y)) * cos(radians(v.y)) * pow(sin((radians(v.x) - radians(s.x)) / 2), 2))) <= 10.0
"""


# What stands for no value in the test tables, listed here anew, so that SQL doesn't repeat the operator's.
NO_VALUE = [
    "", "n a", "na", "nan", "null", "nil", "none", "blank", "empty", "missing", "unknown", "unk", "undefined",
    "unassigned", "unspecified", "undetermined", "not stated", "not known", "not available", "not applicable",
    "not assigned", "not given", "not specified", "not reported", "not recorded", "no data", "no value", "void",
    "tbd", "tba", "tbc", "to be determined", "pending", "x", "xx", "xxx", "xxxx",
]

P5_POSITIONS = """
WITH c AS (SELECT site_id, collector_code AS e, surveyed_at AS t, unnest([{'f': 'x_m', 'v': x_m}, {'f': 'y_m', 'v': y_m}]) AS c FROM sites WHERE collector_code IS NOT NULL),
d AS (SELECT site_id, e, t, c.f, CASE WHEN NOT isnan(c.v) THEN c.v END AS v FROM c),
l AS (SELECT e, f, t, avg(v) AS v FROM d GROUP BY 1, 2, 3),
o AS (SELECT e, f, t, v FROM l WHERE v IS NOT NULL AND t IS NOT NULL),
m AS (SELECT site_id, e, f, t FROM d WHERE v IS NULL),
p AS (SELECT m.*, o.t AS pt, o.v AS pv FROM m ASOF LEFT JOIN o ON m.e = o.e AND m.f = o.f AND m.t > o.t),
n AS (SELECT p.*, o.t AS nt, o.v AS nv FROM p ASOF LEFT JOIN o ON p.e = o.e AND p.f = o.f AND p.t < o.t),
g AS (SELECT n.*, l.v AS same, epoch_us(n.t) AS u, (epoch_us(n.t) - epoch_us(pt)) / 86400e6 AS dp, (epoch_us(nt) - epoch_us(n.t)) / 86400e6 AS dn FROM n LEFT JOIN l ON l.e = n.e AND l.f = n.f AND l.t = n.t)
SELECT site_id, f AS field, round(CASE WHEN same IS NOT NULL THEN same WHEN dp IS NOT NULL AND dn IS NOT NULL AND least(dp, dn) <= 366 THEN (pv * dn + nv * dp) / (dp + dn) WHEN dp IS NULL OR dn < dp THEN nv ELSE pv END, 3) AS fill,
 CASE WHEN same IS NOT NULL THEN 'same_time' WHEN dp IS NOT NULL AND dn IS NOT NULL AND least(dp, dn) <= 366 THEN 'interpolated' WHEN least(dp, dn) > 366 THEN 'beyond_gap' WHEN dp IS NULL OR dn < dp THEN 'carried_back' ELSE 'carried_forward' END AS method,
 round(CASE WHEN same IS NOT NULL THEN 0.0 ELSE least(dp, dn) END, 6) AS distance_days
FROM g WHERE t IS NOT NULL AND (same IS NOT NULL OR pv IS NOT NULL OR nv IS NOT NULL)
"""


def _p5() -> str:
    words = ", ".join(f"'{w}'" for w in NO_VALUE)
    name = "CASE WHEN regexp_matches({c}, '\\p{{L}}') AND trim(lower(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))) NOT IN ({words}) THEN 1 END"
    has = {"county": name.format(c="county", words=words), "district": name.format(c="district", words=words), "district_no": "CASE WHEN district_no BETWEEN 1 AND 60 THEN 1 END"}
    cells = " UNION ALL ".join(f"SELECT seg_id, precinct_code, '{f}' AS field, {e} AS has FROM precinct_segments" for f, e in has.items())
    return f"SELECT seg_id, field FROM (SELECT *, max(has) OVER (PARTITION BY precinct_code, field) AS any_has FROM ({cells}) WHERE precinct_code IS NOT NULL) WHERE has IS NULL AND any_has = 1"


def _p5_fills() -> str:
    """The rule of filling in words: values in one spelling, the most frequent of a time, the nearest of other times."""
    words = ", ".join(f"'{w}'" for w in NO_VALUE)
    name = "CASE WHEN regexp_matches({c}, '\\p{{L}}') AND trim(lower(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))) NOT IN ({words}) THEN trim(regexp_replace({c}, '\\s+', ' ', 'g')) END"
    value = {"county": name.format(c="county", words=words), "district": name.format(c="district", words=words), "district_no": "CASE WHEN district_no BETWEEN 1 AND 60 THEN CAST(district_no AS VARCHAR) END"}
    cells = " UNION ALL ".join(f"SELECT seg_id, precinct_code AS e, edition AS t, '{f}' AS f, {v} AS v FROM precinct_segments WHERE precinct_code IS NOT NULL" for f, v in value.items())
    return f"""
WITH c AS ({cells}),
s AS (SELECT e, f, t, upper(v) AS k, v, count(*) AS n FROM c WHERE v IS NOT NULL GROUP BY ALL),
k AS (SELECT e, f, t, k, sum(n) AS n, first(v ORDER BY v = k, n DESC, v) AS v FROM s GROUP BY ALL),
l AS (SELECT e, f, t, first(v ORDER BY n DESC, v) AS v FROM k GROUP BY ALL),
a AS (SELECT e, f, first(v ORDER BY n DESC, v) AS v FROM (SELECT e, f, v, count(*) AS n FROM l GROUP BY ALL) GROUP BY ALL),
o AS (SELECT * FROM l WHERE t IS NOT NULL),
m AS (SELECT seg_id, e, f, t FROM c WHERE v IS NULL),
p AS (SELECT m.*, o.t AS pt, o.v AS pv FROM m ASOF LEFT JOIN o ON m.e = o.e AND m.f = o.f AND m.t > o.t),
q AS (SELECT p.*, o.t AS nt, o.v AS nv FROM p ASOF LEFT JOIN o ON p.e = o.e AND p.f = o.f AND p.t < o.t),
g AS (SELECT q.*, o.v AS same, (epoch_us(q.t) - epoch_us(pt)) / 86400e6 AS dp, (epoch_us(nt) - epoch_us(q.t)) / 86400e6 AS dn, a.v AS any_v FROM q JOIN a USING (e, f) LEFT JOIN o ON o.e = q.e AND o.f = q.f AND o.t = q.t),
d AS (SELECT *, coalesce(pt IS NULL OR dn < dp, false) AS back, coalesce(upper(pv) = upper(nv), false) AS agreed FROM g),
r AS (SELECT seg_id, f, any_v, CASE WHEN same IS NOT NULL THEN same WHEN agreed OR NOT back THEN coalesce(pv, nv) ELSE nv END AS fill,
 CASE WHEN same IS NOT NULL THEN 'same_time' WHEN agreed AND least(dp, dn) <= 366 THEN 'agreed' WHEN least(dp, dn) > 366 THEN 'beyond_gap' WHEN back THEN 'carried_back' ELSE 'carried_forward' END AS method,
 CASE WHEN same IS NOT NULL THEN 0.0 ELSE least(dp, dn) END AS days FROM d)
SELECT seg_id, f AS field, coalesce(fill, any_v) AS fill, CASE WHEN fill IS NULL THEN 'any_time' ELSE method END AS method, CASE WHEN fill IS NOT NULL THEN days END AS distance_days FROM r
"""


def _p5_filled() -> str:
    words = ", ".join(f"'{w}'" for w in NO_VALUE)
    has = "regexp_matches({c}, '\\p{{L}}') AND trim(lower(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))) NOT IN ({words})"
    cols, joins = [], []
    for f in ("county", "district", "district_no"):
        good = "district_no BETWEEN 1 AND 60" if f == "district_no" else has.format(c=f"s.{f}", words=words)
        fill = "CAST(x_district_no.fill AS INTEGER)" if f == "district_no" else f"x_{f}.fill"
        cols.append(f"CASE WHEN {good} THEN s.{f} ELSE {fill} END AS {f}, x_{f}.method AS {f}_method, x_{f}.distance_days AS {f}_days")
        joins.append(f"LEFT JOIN (SELECT * FROM z WHERE field = '{f}') x_{f} ON x_{f}.seg_id = s.seg_id")
    return f"WITH z AS ({_p5_fills()}) SELECT s.seg_id, precinct_code, precinct_name, street_name, from_no, to_no, edition, loaded_at, {', '.join(cols)} FROM precinct_segments s {' '.join(joins)}"


def _members(source: str, keep: str, parent: str, name: str, kind: str) -> str:
    """Objects under a key in any letter case: one that stands alone, or those of an array, with their place in it."""
    listed = f"SELECT {keep}, CASE WHEN json_type(v) = 'OBJECT' THEN json_array(v) ELSE v END AS a FROM (SELECT {keep}, json_extract(o, '$.\"' || k || '\"') AS v FROM (SELECT {keep}, {parent} AS o, unnest(json_keys({parent})) AS k FROM {source}) WHERE lower(k) = '{name}')"
    return f"SELECT {keep}, i AS {kind}, e FROM (SELECT {keep}, i, json_extract(a, '$[' || i || ']') AS e FROM (SELECT {keep}, a, unnest(range(CAST(json_array_length(a) AS BIGINT))) AS i FROM ({listed}) WHERE json_type(a) = 'ARRAY')) WHERE json_type(e) = 'OBJECT'"


P2_CUT = f"""
WITH a AS (SELECT packet_id, CASE WHEN json_type(j) = 'ARRAY' THEN j WHEN json_extract_string(j, '$.type') = 'FeatureCollection' THEN json_extract(j, '$.features') ELSE json_array(j) END AS a FROM (SELECT packet_id, CAST(body AS JSON) AS j FROM feature_packets WHERE body <> '')),
f AS (SELECT packet_id, n, json_extract(a, '$[' || n || ']') AS f FROM (SELECT packet_id, a, unnest(range(CAST(json_array_length(a) AS BIGINT))) AS n FROM a)),
g AS (SELECT packet_id, n, CASE WHEN json_extract_string(f, '$.geometry.type') = 'GeometryCollection' THEN json_extract(f, '$.geometry.geometries') ELSE json_array(json_extract(f, '$.geometry')) END AS gs FROM f WHERE json_type(json_extract(f, '$.geometry')) = 'OBJECT'),
h AS (SELECT packet_id, n, gi, json_extract(gs, '$[' || gi || ']') AS g FROM (SELECT packet_id, n, gs, unnest(range(CAST(json_array_length(gs) AS BIGINT))) AS gi FROM g)),
l AS (SELECT packet_id, n, gi, CASE WHEN json_extract_string(g, '$.type') = 'LineString' THEN json_array(json_extract(g, '$.coordinates')) ELSE json_extract(g, '$.coordinates') END AS ls FROM h WHERE json_extract_string(g, '$.type') IN ('LineString', 'MultiLineString')),
m AS (SELECT packet_id, n, gi, li, json_extract(ls, '$[' || li || ']') AS line FROM (SELECT packet_id, n, gi, ls, unnest(range(CAST(json_array_length(ls) AS BIGINT))) AS li FROM l WHERE json_type(ls) = 'ARRAY')),
p AS (SELECT packet_id, n, CASE WHEN json_type(json_extract(f, '$.properties')) = 'VARCHAR' THEN CAST(json_extract_string(f, '$.properties') AS JSON) ELSE json_extract(f, '$.properties') END AS p FROM f),
o AS (SELECT packet_id, n, p FROM p WHERE json_type(p) = 'OBJECT'),
w AS ({_members("o", "packet_id, n", "p", "wui", "wi")}),
r AS ({_members("w", "packet_id, n, wi", "e", "rev", "ri")}),
x AS (SELECT packet_id, n, CAST(row_number() OVER (PARTITION BY packet_id, n ORDER BY gi, li) - 1 AS INTEGER) AS part_no, line FROM m WHERE json_array_length(line) > 0)
"""
P2 = f"""{P2_CUT}
SELECT packet_id, CAST(n AS INTEGER) AS feature_no, 'part' AS child, CAST(row_number() OVER (PARTITION BY packet_id, n ORDER BY gi, li) - 1 AS INTEGER) AS child_no, -1 AS sub_no FROM m WHERE json_array_length(line) > 0
UNION ALL SELECT packet_id, CAST(n AS INTEGER), 'wui', CAST(wi AS INTEGER), -1 FROM w
UNION ALL SELECT packet_id, CAST(n AS INTEGER), 'rev', CAST(wi AS INTEGER), CAST(ri AS INTEGER) FROM r
"""
_S = "json_extract_string({o}, '$.{k}')"
P2_FEATURES = f"""{P2_CUT}
SELECT f.packet_id, CAST(f.n AS INTEGER) AS feature_no, {_S.format(o="f", k="id")} AS feature_id, {_S.format(o="f", k="geometry.type")} AS geometry_type,
 CAST(trunc(try_cast({_S.format(o="p", k="OBJECTID")} AS DOUBLE)) AS BIGINT) AS objectid, {_S.format(o="p", k="PBG00")} AS pbg00, try_cast({_S.format(o="p", k="RANK")} AS INTEGER) AS rank, {_S.format(o="p", k="TYPE")} AS type, {_S.format(o="p", k="id")} AS id
FROM f LEFT JOIN p ON p.packet_id = f.packet_id AND p.n = f.n WHERE json_type(f) = 'OBJECT'
"""
P2_HU = f"""{P2_CUT}
SELECT packet_id, CAST(n AS INTEGER) AS feature_no, k AS hu_name, CAST(json_extract_string(h, '$."' || k || '"') AS DOUBLE) AS hu_share FROM (SELECT packet_id, n, h, unnest(json_keys(h)) AS k FROM (SELECT packet_id, n, json_extract(p, '$.HU') AS h FROM o) WHERE json_type(h) = 'OBJECT')
"""
P2_POINTS = f"""{P2_CUT}
SELECT packet_id, CAST(n AS INTEGER) AS feature_no, part_no, CAST(i AS INTEGER) AS point_no, CAST(json_extract(line, '$[' || i || '][0]') AS DOUBLE) AS x, CAST(json_extract(line, '$[' || i || '][1]') AS DOUBLE) AS y, CAST(json_extract(line, '$[' || i || '][2]') AS DOUBLE) AS z
FROM (SELECT packet_id, n, part_no, line, unnest(range(CAST(json_array_length(line) AS BIGINT))) AS i FROM x)
"""
P2_WUI = f"""{P2_CUT}
SELECT packet_id, CAST(n AS INTEGER) AS feature_no, CAST(wi AS INTEGER) AS wui_no, try_cast({_S.format(o="e", k="YEAR")} AS INTEGER) AS year, try_cast({_S.format(o="e", k="FLAG")} AS INTEGER) AS flag, {_S.format(o="e", k="CLASS")} AS class, {_S.format(o="e", k="SRC.SHEET")} AS src_sheet, try_cast({_S.format(o="e", k="SRC.BY.CREW")} AS INTEGER) AS src_crew FROM w
"""
P2_REV = f"""{P2_CUT}
SELECT packet_id, CAST(n AS INTEGER) AS feature_no, CAST(wi AS INTEGER) AS wui_no, CAST(ri AS INTEGER) AS rev_no, try_cast({_S.format(o="e", k="NO")} AS INTEGER) AS no, try_cast({_S.format(o="e", k="VEG01PC")} AS DOUBLE) AS veg01pc FROM r
"""


def oracle_sql() -> dict[str, str]:
    return {"p2_features": P2_FEATURES, "p2_hu": P2_HU, "p2_points": P2_POINTS, "p2_wui": P2_WUI, "p2_rev": P2_REV, "p3_rejects": P3_REJECTS, "p3_loaded": P3_LOADED, "p5_fills": _p5_fills(), "p5_filled": _p5_filled(), "p2_found": P2, "p3_found": P3, "p4_found": P4, "p4_near_counts": P4_COUNTS, "p4_near_sphere": P4_SPHERE, "p5_found": _p5(), "p5_positions": P5_POSITIONS}
