import json
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from featurekit import stac
from featurekit.cli import run
from featurekit.describe import describe
from featurekit.operators.improve import improve
from featurekit.operators.union import merge
from featurekit.plans.validate import validate
from featurekit.schema.collection import dehydrate, hydrate
from featurekit.sources import geojson, geoparquet
from tests.fixtures import INSPIRE, admin, inspire, mixed, put


def two(**props):
    a, b = inspire("1"), inspire("2", **props)
    return {k: v for k, v in a.items() if k.startswith("schemas")} | {"type": "FeatureCollection", "features": [{k: v for k, v in f.items() if not k.startswith("schemas")} for f in (a, b)]}


def test_geojson_scan(spark, tmp_path):
    t = geojson.read_geojson(spark, put(tmp_path, "a.json", admin()))
    assert set(t.columns) == {"id", "geometry", "admin:country_code", "admin:subdivision_code", "collection", "depth_class"}
    assert t.collection.schemas and t.df.first()["id"] == "lake-7"
    m = geojson.read_geojson(spark, put(tmp_path, "m.json", mixed()))
    assert m.df.count() == 2 and dict(m.df.dtypes)["surveyed"] == "timestamp"
    assert geojson.read_geojson(spark, put(tmp_path, "m.json", mixed()), num=0).df.count() == 0
    assert geojson.read_geojson(spark, put(tmp_path, "m.json", mixed()), num=1, properties=["id", "nothing"]).df.columns == ["id"]
    with pytest.raises(Exception, match="Only Feature"):
        geojson.read_geojson(spark, put(tmp_path, "x.json", {"type": "Point", "coordinates": [1, 2]})).df.collect()


def test_hydrate_and_dehydrate(spark, tmp_path):
    t = geojson.read_geojson(spark, put(tmp_path, "t.json", two()))
    small = dehydrate(t)
    assert small.collection["surveyed"] == "2021-06-15T12:00:00Z"
    assert small.collection["collection"] == "mires" and "collection" in small.columns
    assert "surveyed" not in small.columns and "inspire:id" in small.columns
    assert "surveyed" in hydrate(small).columns
    one = geojson.read_geojson(spark, put(tmp_path, "o.json", inspire()))
    assert dehydrate(one).columns == one.columns


def test_geoparquet_round_trip(spark, tmp_path):
    t = geojson.read_geojson(spark, put(tmp_path, "t.json", two()))
    path = str(tmp_path / "out.parquet")
    geoparquet.write_geoparquet(t, path, single_file=True)
    f = geoparquet.footer(path)
    assert (f.rows, f.groups, f.compression, f.geo["version"]) == (2, 1, "zstd", "1.1.0")
    assert set(f.collection) == {"collection", "surveyed", "schemas", "schemas:custom"}
    assert pq.ParquetFile(path).metadata.num_columns == 8
    assert not f.schema.field("id").nullable and f.geo["columns"]["geometry"]["geometry_types"] == ["Polygon"]
    back = geoparquet.read_geoparquet(spark, path, hydrate=True)
    assert back.df.count() == 2 and back.crs == "EPSG:4326" and "surveyed" in back.columns
    assert geoparquet.read_geoparquet(spark, path, num=0).df.count() == 0
    plan = geoparquet.read_geoparquet(spark, path, properties=["id", "bbox"]).df.filter("bbox.xmin > 3")._jdf.queryExecution().toString()
    assert "GreaterThan(bbox.xmin,3.0)" in plan and "geometry" not in plan.partition("ReadSchema")[2]
    geoparquet.write_geoparquet(t, str(tmp_path / "old"), version="1.0.0", compression=None)
    old = geoparquet.footer(str(tmp_path / "old"))
    assert "bbox" not in old.schema.names and old.compression is None
    out = str(tmp_path / "back.json")
    geojson.write_geojson(back, out)
    assert [x["id"] for x in json.loads(open(out).read())["features"]] == ["1", "2"]
    files = geojson.write_features(back, str(tmp_path / "each"), indent=2)
    assert [f.rpartition("/")[2] for f in files] == ["1.json", "2.json"]


def test_empty_and_three_dimensional_tables(spark, tmp_path):
    t = geojson.read_geojson(spark, put(tmp_path, "t.json", two()))
    geoparquet.write_geoparquet(t.with_(df=t.df.limit(0)), str(tmp_path / "none.parquet"), single_file=True)
    assert geoparquet.footer(str(tmp_path / "none.parquet")).rows == 0
    high = t.with_(df=t.df.withColumn("geometry", F.struct(F.lit("Point").alias("type"), F.array(F.array(F.array(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))))).alias("parts"))))
    with pytest.raises(ValueError, match="three dimensions"):
        geoparquet.write_geoparquet(high, str(tmp_path / "z.parquet"))


def test_merge_and_improve(spark, tmp_path):
    t = merge([geojson.read_geojson(spark, put(tmp_path, "a.json", admin())), geojson.read_geojson(spark, put(tmp_path, "b.json", inspire()))])
    assert t.df.count() == 2 and set(t.collection.schemas) == {"lakes", "mires"}
    better = improve(t, rename={"depth_class": "bottom"}, sizes=True, fix=True, explode=True)
    assert "bottom" in better.columns and better.df.filter("`metrics:area` > 0").count() == 2
    moved = improve(t, crs="EPSG:25832")
    assert moved.crs == "EPSG:25832"


VALID = [("a.json", admin()), ("i.json", inspire()), ("m.json", mixed())]


@pytest.mark.parametrize("name,value", VALID)
def test_valid(spark, tmp_path, name, value):
    r = validate(spark, put(tmp_path, name, value))
    assert r.errors == [] and r.is_valid()


def test_invalid(spark, tmp_path):
    assert validate(spark, put(tmp_path, "x.json", inspire(**{"inspire:id": 48.5}))).errors == ["48.5 is not of type 'string'"]
    path = put(tmp_path, "m.json", mixed(**{"admin:country_code": "FIN"}))
    assert validate(spark, path).errors == ["'FIN' is too long", "'FIN' does not match '^[A-Z]{2}$'"]
    t = geojson.read_geojson(spark, path)
    geoparquet.write_geoparquet(t, str(tmp_path / "m.parquet"), single_file=True)
    assert validate(spark, str(tmp_path / "m.parquet")).errors == ["admin:country_code: String 'FIN' is longer than the maximum length of 2.", "admin:country_code: String 'FIN' does not match the required pattern: ^[A-Z]{2}$."]
    for want in (INSPIRE, re.compile(INSPIRE.replace("0.3.0", r"0.3.\d+"))):
        text = want if isinstance(want, str) else want.pattern
        assert validate(spark, put(tmp_path, "n.json", mixed()), required=[want]).errors == [f"Collection 'lakes': Required schema {text} not found"]
    assert not validate(spark, str(tmp_path / "gone.parquet")).is_valid()
    assert not validate(spark, str(tmp_path / "gone.json")).is_valid()


def test_describe(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    geoparquet.write_geoparquet(geojson.read_geojson(spark, put(tmp_path, "t.json", two())), path, single_file=True)
    out = describe(spark, path, num=1)
    for want in ("Format: GeoParquet, version 1.1.0", "Columns: 8", "Rows: 2", "Row Groups: 1", "Version: 0.1.0", f"- {INSPIRE}", "geometry: binary", "bbox: struct<xmin: double, ymin: double, xmax: double, ymax: double>", "surveyed: 2021-06-15T12:00:00Z", "collection: mires"):
        assert want in out
    assert "Omitted" in describe(spark, path, num=0)
    text = describe(spark, put(tmp_path, "i.json", inspire()), verbose=True)
    assert "File format is not columnar" in text and "Custom Schemas: Yes" in text and "schemas:custom:" in text
    with pytest.raises(FileNotFoundError):
        describe(spark, "gone.json")


def test_stac(spark, tmp_path):
    value = two() | {"description": "Fields", "license": "dl-de/by-2-0", "provider": "Land <https://example.org>", "collection": "mires"}
    t = geojson.read_geojson(spark, put(tmp_path, "t.json", value))
    doc = stac.collection_document(t, "file:///t.json", "application/geo+json", "surveyed")
    assert doc["id"] == "mires" and doc["extent"]["temporal"]["interval"] == [["2021-06-15T12:00:00Z"] * 2]
    assert doc["extent"]["spatial"]["bbox"][0] == pytest.approx([24, 65, 24.25, 65.25])
    assert doc["links"][0]["rel"] == "license" and doc["providers"][0]["url"] == "https://example.org"
    with pytest.raises(ValueError, match="a description"):
        stac.collection_document(t.with_(collection=type(t.collection)({k: v for k, v in t.collection.items() if k != "description"})), "x")
    with pytest.raises(ValueError, match="exactly one collection"):
        stac.collection_document(geojson.read_geojson(spark, put(tmp_path, "m.json", mixed())), "x")


def test_cli(spark, tmp_path, capsys):
    a, b, out = put(tmp_path, "a.json", admin()), put(tmp_path, "b.json", inspire()), str(tmp_path / "o.parquet")
    assert run(["create-geoparquet", a, b, "-o", out], spark) == 0 and geoparquet.footer(out).rows == 2
    assert run(["validate", a, out], spark) == 0
    assert run(["merge", a, b, "-o", str(tmp_path / "m.json"), "-i", "depth_class"], spark) == 0
    assert run(["improve", out, "-sz", "-o", str(tmp_path / "s.parquet")], spark) == 0
    assert "metrics:area" in geoparquet.footer(str(tmp_path / "s.parquet")).schema.names
    assert run(["describe", out], spark) == 0 and "FILE SUMMARY" in capsys.readouterr().out
    assert run(["create-geojson", out, "-f", "-o", str(tmp_path / "each")], spark) == 0
    schema = put(tmp_path, "s.json", {"$schema": "https://schemas.example.org/sdl/v0.2.0/schema.json", "properties": {"x": {"type": "STRING"}}})
    assert run(["validate-schema", schema], spark) == 1
    assert run(["converters"], spark) == 0


