import sqlite3
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from featurekit.functions.wkb import encode
from featurekit.plans import convert
from featurekit.sources import discover, geoparquet, gpkg, shapefile
from featurekit.streaming.landing import convert_stream, read_lines, windowed_counts
from tests.fixtures import inspire, put

RING = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0], [0.0, 0.0]]
BOW = [[0.0, 0.0], [2.0, 2.0], [2.0, 0.0], [0.0, 2.0], [0.0, 0.0]]


def package(path):
    """A GeoPackage of three rows: a square, a bow-tie, and one of a type that the filter takes out."""
    db = sqlite3.connect(path)
    db.executescript("""CREATE TABLE gpkg_contents(table_name, data_type); INSERT INTO gpkg_contents VALUES ('fields', 'features');
    CREATE TABLE gpkg_spatial_ref_sys(srs_id, organization, organization_coordsys_id); INSERT INTO gpkg_spatial_ref_sys VALUES (4326, 'EPSG', 4326);
    CREATE TABLE gpkg_geometry_columns(table_name, column_name, srs_id); INSERT INTO gpkg_geometry_columns VALUES ('fields', 'geom', 4326);
    CREATE TABLE fields(fid INTEGER PRIMARY KEY, geom BLOB, parcel TEXT, kind TEXT, since TEXT, m2 REAL);""")
    head = b"GP\x00\x01" + struct.pack("<i", 4326)
    for i, (r, kind) in enumerate([(RING, "a"), (BOW, None), (RING, "water")]):
        db.execute("INSERT INTO fields VALUES (?, ?, ?, ?, ?, ?)", (i + 1, head + encode("Polygon", [[r]]), f"F{i}", kind, "3.12.2020", 10000.0 * (i + 1)))
    db.commit()
    db.close()
    return str(path)


class Fields(convert.AdminConverter):
    id = "fi_bogs"
    admin_subdivision_code = "LAP"
    title = "Fields"
    description = "Test"
    sources = "gone.gpkg"
    columns = {"geometry": "geometry", "parcel": ["id", "parcel"], "since": "surveyed", "m2": "area"}
    column_filters = {"kind": lambda c: (c.isin("water"), True)}
    column_migrations = {"since": lambda c: F.to_timestamp(c, "d.M.yyyy"), "m2": lambda c: c * 0.0001}
    missing_schemas = {"properties": {"parcel": {"type": "string"}, "surveyed": {"type": "date-time"}, "area": {"type": "float", "minimum": 0}}}


def test_converter(spark, tmp_path):
    path = package(tmp_path / "f.gpkg")
    with zipfile.ZipFile(tmp_path / "f.zip", "w") as z:
        z.write(path, "in/f.gpkg")
    t = Fields().convert(spark, [f"{tmp_path / 'f.zip'}|in/f.gpkg"], cache=str(tmp_path / "cache"))
    got = sorted(map(tuple, t.df.select("id", "area", "admin:country_code", "collection").collect()))
    # The bow-tie falls into two triangles; the row of an unknown kind stays, as masks are two-valued.
    assert got == [("F0", 1.0, "FI", "fi_bogs"), ("F1", 2.0, "FI", "fi_bogs"), ("F1", 2.0, "FI", "fi_bogs")]
    out = str(tmp_path / "o.parquet")
    convert.convert_file(spark, Fields(), out, single_file=True, inputs=[path])
    f = geoparquet.footer(out)
    assert f.rows == 3 and str(f.schema.field("area").type) == "float" and f.collection["admin:subdivision_code"] == "LAP"
    assert Fields.column_additions == {}


def test_guards(spark, tmp_path):
    class Closed(Fields):
        data_access = "Ask first"

    with pytest.raises(PermissionError, match="Ask first"):
        Closed().convert(spark)

    class Layers(Fields):
        def layer_filter(self, layer, uri):
            return False

    with pytest.raises(ValueError, match="No layers"):
        Layers().convert(spark, [package(tmp_path / "f.gpkg")])
    with pytest.raises(ValueError, match="Unknown variant"):
        discover.choose_sources(None, {"2020": "a"}, "2021")
    assert discover.choose_sources(None, {"2020": "x/a.zip"}, None) == {"x/a.zip": "a.zip"}
    assert discover.parse_input("a.zip|b, c") == ("a.zip", ["b", "c"]) and discover.parse_input("a.zip") == ("a.zip", None)


def test_plugins(tmp_path, monkeypatch):
    folder = tmp_path / "plugins_here"
    folder.mkdir()
    (folder / "__init__.py").write_text("")
    (folder / "good.py").write_text("from featurekit.plans.convert import Converter\nclass C(Converter):\n    id = 'x'\n")
    (folder / "broken.py").write_text("def (:\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    found = convert.discover("plugins_here")
    assert found["good"].id == "x" and isinstance(found["broken"], SyntaxError)
    assert convert.load(str(folder / "good.py")).id == "x"


def test_discovery(tmp_path):
    for n in ("a.json", "b.PARQUET", "collection.json", "c.txt"):
        (tmp_path / n).write_text("")
    assert [p.rpartition("/")[2] for p in discover.expand(tmp_path)] == ["a.json", "b.PARQUET"]
    assert discover.encoding_of("x.geojson") == "geojson"
    with pytest.raises(ValueError, match="Unsupported"):
        discover.encoding_of("x.shp")
    assert discover.one_file(str(tmp_path / "a.*")).endswith("a.json")
    with pytest.raises(ValueError, match="matches"):
        discover.one_file(str(tmp_path / "*.json*"))


def test_geopackage_ranges(spark, tmp_path, monkeypatch):
    path = package(tmp_path / "f.gpkg")
    assert gpkg.layers(path) == ["fields"] and gpkg.describe(path, "fields")[2] == "EPSG:4326"
    df = gpkg.read(spark, path, "fields")
    assert df.count() == 3 and df.filter("geometry.type = 'Polygon'").count() == 3


def test_shapefile(spark, tmp_path):
    ring = RING[::-1]  # shells run with the clock
    body = struct.pack("<i4d2i1i", 5, 0, 0, 1, 1, 1, len(ring), 0) + b"".join(struct.pack("<2d", *p) for p in ring)
    record = struct.pack(">2i", 1, len(body) // 2) + body
    head = lambda n: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, n // 2) + struct.pack("<2i8d", 1000, 5, *[0.0] * 8)
    (tmp_path / "s.shp").write_bytes(head(100 + len(record)) + record)
    (tmp_path / "s.shx").write_bytes(head(108) + struct.pack(">2i", 50, len(body) // 2))
    cols = b"".join(n.ljust(11, b"\0") + k + b"\0" * 4 + bytes([w, d]) + b"\0" * 14 for n, k, w, d in ((b"NAME", b"C", 5, 0), (b"N", b"N", 4, 1)))
    (tmp_path / "s.dbf").write_bytes(struct.pack("<4BIHH", 3, 20, 1, 1, 1, 32 + len(cols) + 1, 10) + b"\0" * 20 + cols + b"\r" + b" abc   1.5"[:10])
    row = shapefile.read(spark, str(tmp_path / "s.shp")).first()
    assert row["NAME"] == "abc" and row["N"] == 1.5 and row["geometry"]["type"] == "Polygon" and row["geometry"]["parts"] == [[ring]]


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    put(folder, "a.json", {k: v for k, v in inspire().items() if not k.startswith("schemas")})

    class Landing(convert.Converter):
        id = "inspire"
        columns = {"id": "id", "geometry": "geometry", "inspire:id": "code"}

    q = convert_stream(read_lines(spark, str(folder), {"inspire:id": "string"}), Landing(), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).select("id", "collection").collect()[0] == ("1", "inspire")
    events = spark.createDataFrame([("2020-01-01 00:10:00", "a"), ("2020-01-01 00:20:00", "a"), ("2020-01-01 01:10:00", "a")], "ts string, k string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r["n"] for r in windowed_counts(events, "ts", "k").collect()) == [1, 2]
