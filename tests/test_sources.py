import json

import pytest

from geolathe.layer import GEOM, LayerError
from geolathe.sources import formats as fmt
from geolathe.sources import io as IO
from geolathe.streaming import stateless as ST

SHAPES = {
    "type": "FeatureCollection",
    "features": [
        {"type": "Feature", "properties": {"n": "ä", "k": 1, "f": 1.5}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], [[1, 1], [1, 2], [2, 2], [1, 1]]]}},
        {"type": "Feature", "properties": {"n": "b", "k": 2, "f": None}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[5, 0], [6, 0], [6, 1], [5, 0]]], [[[7, 0], [8, 0], [8, 1], [7, 0]]]]}},
    ],
}


def plain(layer):
    return sorted((r["n"], r["k"], sorted(map(str, r[GEOM]))) for r in layer.df.collect())


def test_geometry_formats_lead_back(spark, tmp_path):
    (tmp_path / "g.geojson").write_text(json.dumps(SHAPES))
    x = IO.read_json(spark, str(tmp_path / "g.geojson"))["g"]
    want = plain(x)
    assert x.geometry_type == "polygon" and len(want) == 2
    for kind in ("geojson", "topojson", "gpkg", "shapefile", "flatgeobuf"):
        for ext, data in IO.content(x, kind).items():
            (tmp_path / f"{kind}.{ext}").write_bytes(data if isinstance(data, bytes) else data.encode())
        back = {"geojson": lambda: IO.read_json(spark, str(tmp_path / "geojson.json")), "topojson": lambda: IO.read_json(spark, str(tmp_path / "topojson.json")), "gpkg": lambda: IO.read_gpkg(spark, str(tmp_path / "gpkg.gpkg")), "flatgeobuf": lambda: IO.read_fgb(spark, str(tmp_path / "flatgeobuf.fgb")), "shapefile": lambda: IO.read_shapefile(spark, str(tmp_path / "shapefile.shp"))}[kind]()
        assert plain(next(iter(back.values()))) == want, kind
    (tmp_path / "k.kml").write_text(IO.content(x, "kml")["kml"])
    assert [r[GEOM] for r in IO.read_kml(spark, str(tmp_path / "k.kml"))["k"].df.collect()] == [r[GEOM] for r in x.df.collect()]
    IO.write_parquet(x, str(tmp_path / "p.parquet"), "zstd", 5)
    assert plain(IO.read_parquet(spark, str(tmp_path / "p.parquet"))) == want
    IO.write_ndjson(x, str(tmp_path / "nd"))
    assert plain(next(iter(IO.read_json(spark, str(tmp_path / "nd"), ndjson=True).values()))) == want
    IO.save_snapshot({"g": x}, str(tmp_path / "snap"))
    assert plain(IO.load_snapshot(spark, str(tmp_path / "snap"))["g"]) == want


def test_csv(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text('﻿id,name,v,code,name\n1,"a, b",1.5,01,x\n2,,NA,2x,y\n3,"q ""z""",2,3,z\n', encoding="utf-8")
    x = IO.read_csv(spark, str(p))
    assert [tuple(r)[1:] for r in x.df.orderBy("_fid").collect()] == [(1.0, "a, b", 1.5, "01", "x"), (2.0, "", None, "2x", "y"), (3.0, 'q "z"', 2.0, "3", "z")]
    assert x.fields == ["id", "name", "v", "code", "name_1"]
    assert IO.content(x, "csv")["csv"].split("\n")[1:3] == ['1,"a, b",1.5,01,x', "2,,,2x,y"]
    y = IO.read_csv(spark, str(p), fields=["name", "id"], lines=2, string_fields=["id"], where="id > 1")
    assert [tuple(r)[1:] for r in y.df.orderBy("_fid").collect()] == [("", "2"), ('q "z"', "3")]
    with pytest.raises(LayerError):
        IO.read_csv(spark, str(p), fields=["none"])
    (tmp_path / "c.csv").write_text("skip me\na;b\n1.000,5;x\n2,25;y\n")
    z = IO.read_csv(spark, str(tmp_path / "c.csv"), skip_lines=1, decimal_comma=True)
    assert [r["a"] for r in z.df.orderBy("_fid").collect()] == [1000.5, 2.25]
    (tmp_path / "e.csv").write_text("")
    assert IO.read_csv(spark, str(tmp_path / "e.csv")).df.count() == 0


def test_json_records_and_fixed_width(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"data": {"rows": [{"a": 1}, {"b": "x", "a": null}]}}')
    x = IO.read_json(spark, str(tmp_path / "r.json"), "data/rows")["r"]
    assert [r.asDict() for r in x.df.drop("_fid").collect()] == [{"a": 1, "b": None}, {"a": None, "b": "x"}]
    (tmp_path / "f.txt").write_text("id   name  v\n1    ab    2.5\n22   cde   3\n")
    assert [tuple(r) for r in IO.read_fixed_width(spark, str(tmp_path / "f.txt")).df.drop("_fid").collect()] == [(1.0, "ab", 2.5), (22.0, "cde", 3.0)]
    assert IO.file_type("x", "  {") == "json" and IO.file_type("a.SHP") == "shp"


def test_wkb_dimensions_and_order():
    import struct

    z = struct.pack(">BI3d", 0, 1001, 1.0, 2.0, 3.0)
    assert fmt.from_wkb(z) == {"point": [[1.0, 2.0]]}
    e = struct.pack("<BIId", 1, 0x20000001, 4326, 5.0) + struct.pack("<d", 6.0)
    assert fmt.from_wkb(e) == {"point": [[5.0, 6.0]]}


def test_stream(spark, tmp_path):
    spark.range(20).selectExpr("id", "id % 3 AS g", "CAST(id AS DOUBLE) AS v").write.parquet(str(tmp_path / "s"))
    from geolathe.operators import table as T

    got = ST.available(spark, str(tmp_path / "s"), lambda x: T.each(T.filter_rows(x, "g == 1"), "w = v * 2"), "id")
    assert sorted(r["w"] for r in got.collect()) == [2.0 * i for i in range(20) if i % 3 == 1]


def test_lines_are_skipped_in_every_file(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"s{i}.csv").write_text(f"made by x\n\na,b\n{i},p\n{i + 10},q\n")
    x = IO.read_csv(spark, [str(tmp_path / f"s{i}.csv") for i in range(3)], skip_lines=2)
    assert sorted((r["a"], r["b"]) for r in x.df.collect()) == [(float(i), "p") for i in range(3)] + [(float(i + 10), "q") for i in range(3)]
    y = IO.read_csv(spark, [str(tmp_path / f"s{i}.csv") for i in range(2)], skip_lines=3, field_names=["u", "v"])
    assert sorted(r["u"] for r in y.df.collect()) == [0.0, 1.0, 10.0, 11.0]


def test_the_last_column_of_fixed_width_is_open(spark, tmp_path):
    (tmp_path / "w.txt").write_text("id  note\n" + "".join(f"{i:<4}ab cd\n" for i in range(300)) + "7   " + "x" * 5000 + "\n")
    x = IO.read_fixed_width(spark, str(tmp_path / "w.txt"))
    assert x.fields == ["id", "note"] and x.df.where("length(note) = 5000").count() == 1 and x.df.count() == 301


def test_output_to_a_path_is_written_by_tasks(spark, tmp_path):
    from geolathe.plans.pipeline import Pipeline

    text = "a,b\n" + "\n".join(f"{i},x{i}" for i in range(50))
    for name in ("t.csv", "t.json", "t.ndjson", "t.csv.gz"):
        p = Pipeline(spark, {"i.csv": text}).run(f"-i i.csv -o {tmp_path}/{name} " + ("format=csv" if name.endswith("gz") else ""))
        assert p.outputs == {name: f"{tmp_path}/{name}"} and (tmp_path / name).is_dir()
        q = Pipeline(spark).run(f"-i {tmp_path}/{name}")
        assert sorted((r["a"], r["b"]) for r in q.layer().df.collect()) == sorted((float(i), f"x{i}") for i in range(50)), name
    (tmp_path / "g.geojson").write_text(json.dumps(SHAPES))
    Pipeline(spark).run(f"-i {tmp_path}/g.geojson -o {tmp_path}/out.geojson")
    assert plain(Pipeline(spark).run(f"-i {tmp_path}/out.geojson").layer()) == plain(IO.read_json(spark, str(tmp_path / "g.geojson"))["g"])
    Pipeline(spark, {"i.csv": text}).run(f"-i i.csv -o {tmp_path}/one.csv single-file")
    assert (tmp_path / "one.csv").read_text() == text


def test_archives_sidecars_and_patterns(spark, tmp_path):
    import zipfile

    from geolathe.plans.pipeline import Pipeline

    (tmp_path / "g.geojson").write_text(json.dumps(SHAPES))
    x = IO.read_json(spark, str(tmp_path / "g.geojson"))["g"]
    parts = {e: d for e, d in IO.content(x, "shapefile").items()}
    parts |= {"cpg": b"UTF-8", "prj": b'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137,298.257223563]]]'}
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        for e, d in parts.items():
            z.writestr(f"in/s.{e}", d)
            (tmp_path / f"s.{e}").write_bytes(d)
        z.writestr("t.csv", "a,b\n1,x\n2,\"y, z\"\n")
    got = Pipeline(spark).run(f"-i {tmp_path}/z.zip").layers
    assert set(got) == {"s", "t"} and plain(got["s"]) == plain(x) and got["s"].crs == "wgs84"
    assert sorted((r["a"], r["b"]) for r in got["t"].df.collect()) == [(1.0, "x"), (2.0, "y, z")]
    assert IO.read_shapefile(spark, str(tmp_path / "s.shp"))["s"].crs == "wgs84"
    for n in "pq":
        (tmp_path / f"m_{n}.csv").write_text("a\n1\n")
    assert set(Pipeline(spark).run(f"-i {tmp_path}/m_*.csv").layers) == {"m_p", "m_q"}


def test_flatgeobuf_by_hand():
    from geolathe.sources import flatgeobuf as fgb

    rows = [([[1.0, 2.0]], {"a": 1, "b": "ä", "c": None, "d": [1, {"x": None}]}), (None, {"a": None, "b": "", "c": 2.5, "d": None}), ([[3.0, 4.0], [5.0, 6.0]], {"a": -7, "b": None, "c": 1, "d": {}})]
    data = fgb.write("t", "point", rows, ["a", "b", "c", "d"])
    assert data[:8] == fgb.MAGIC
    assert [(k, p, d) for _, k, p, d in fgb.read(data, "t")] == [("point", [[1.0, 2.0]], {**rows[0][1]}), (None, None, rows[1][1]), ("point", [[3.0, 4.0], [5.0, 6.0]], {**rows[2][1], "c": 1.0})]
    lines = [([[[0.0, 0.0], [1.0, 1.0]], [[2.0, 2.0], [3.0, 3.0], [4.0, 0.0]]], {})]
    assert [p for _, _, p, _ in fgb.read(fgb.write("l", "polyline", lines, []), "l")] == [lines[0][0]]
    with pytest.raises(ValueError):
        list(fgb.read(b"PK..", "t"))


def test_geoparquet_names_its_geometry_in_the_footer(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    wkb = fmt.to_wkb("point", [[1.0, 2.0]])
    t = pa.table({"shape": pa.array([wkb, None], pa.binary()), "n": [1, 2]}).replace_schema_metadata({"geo": json.dumps({"version": "1.0.0", "primary_column": "shape", "columns": {"shape": {"encoding": "WKB"}}})})
    pq.write_table(t, tmp_path / "g.parquet")
    x = IO.read_parquet(spark, str(tmp_path / "g.parquet"))
    assert x.geometry_type == "point" and x.fields == ["n"] and {r["n"]: r[GEOM] for r in x.df.collect()} == {1: [[1.0, 2.0]], 2: None}
