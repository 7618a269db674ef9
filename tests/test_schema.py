
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featurekit import rename
from featurekit.functions import text
from featurekit.operators import columns as c
from featurekit.operators import rules
from featurekit.operators.union import union
from featurekit.schema import algebra, bundled, jsonschema
from featurekit.schema.collection import Collection, merge_collections, parse_schemas
from featurekit.types import arrow_type, cast_to_schema, count_lost, spark_type
from tests.fixtures import ADMIN, CORE, INSPIRE


def test_merge_narrows():
    a = {"properties": {"x": {"type": "string", "enum": ["a", "b"], "minLength": 1, "maxLength": 9}}, "required": ["x"], "collection": {"x": False}}
    b = {"properties": {"x": {"type": "string", "enum": ["b", "c"], "minLength": 2, "maxLength": 5, "deprecated": True}, "y": {"type": "int8"}}}
    m = algebra.merge(a, b)
    assert m["properties"]["x"] == {"type": "string", "enum": ["b"], "minLength": 2, "maxLength": 5, "deprecated": True}
    assert m["required"] == ["x"] and set(m["properties"]) == {"x", "y"}
    assert a["properties"]["x"]["minLength"] == 1
    with pytest.raises(ValueError, match="Conflicting"):
        algebra.merge(a, b, strict=True)
    with pytest.raises(ValueError, match="context"):
        algebra.merge(a, {"collection": {"x": True}, "properties": {"z": {"type": "string"}}})
    with pytest.raises(ValueError, match="Unsupported"):
        algebra.schema_of({"$schema": "https://x.org/sdl/v0.9.0/schema.json"})
    assert algebra.merge_keyword("additionalProperties", True, {"type": "string"}) == {"type": "string"}
    assert algebra.pick(m, ["x"], {"x": "z"})["required"] == ["z"]
    assert algebra.conflicts({"a": 1, "b": 2}, {"a": 1, "b": 3}) == ["b"]


def test_versions_and_schemas(tmp_path):
    assert bundled.version_matches("0.1.3", ">=0.1.0,<0.2.0") and not bundled.version_matches("0.2.0", ">=0.1.0,<0.2.0") and not bundled.version_matches("x", ">=0.1.0")
    assert parse_schemas([INSPIRE, CORE, ADMIN]) == ("0.1.0", CORE, [ADMIN, INSPIRE])
    path = tmp_path / "s.yaml"
    path.write_text("properties:\n  a:\n    type: string\n")
    assert bundled.parse_schema_map([f"https://a.org/s,{path}"]) == {"https://a.org/s": str(path)}
    assert algebra.resolve(["https://a.org/s"], {"https://a.org/s": str(path)})["https://a.org/s"]["properties"]
    one = bundled.load_file(path)
    one["properties"].clear()
    assert bundled.load_file(path)["properties"]
    with pytest.raises(FileNotFoundError):
        bundled.load_schema("https://nowhere.org/s.yaml")


def test_collections():
    x = Collection({"schemas": {"a": [CORE]}, "title": "t"})
    assert x.add_schema(ADMIN).schemas["a"] == {CORE, ADMIN} and x.schemas["a"] == {CORE}
    assert x.add_schema(ADMIN).remove_schema(ADMIN).schemas == x.schemas
    m = merge_collections([x, Collection({"schemas": {"a": [CORE, ADMIN], "b": [CORE]}, "schemas:custom": {"properties": {"p": {"type": "string"}, "q": {"type": "string"}}}})], ["p"])
    assert m.schemas == {"a": {CORE, ADMIN}, "b": {CORE}} and set(m["schemas:custom"]["properties"]) == {"p"} and "title" not in m


def test_types():
    assert spark_type({"type": "uint64"}) == T.DecimalType(20, 0)
    assert spark_type({"type": "object", "patternProperties": {"x": {"type": "int8"}}}) == T.MapType(T.StringType(), T.ByteType())
    nested = {"type": "object", "required": ["a"], "properties": {"a": {"type": "string"}, "b": {"type": "array", "items": {"type": "float"}}}}
    assert not spark_type(nested)["a"].nullable and str(arrow_type(nested)) == "struct<a: string not null, b: list<item: float>>"
    for bad in ({"type": "object", "additionalProperties": True}, {"type": "object", "patternProperties": {"a": {}, "b": {}}}, {"type": "decimal"}):
        with pytest.raises(ValueError):
            spark_type(bad)


def test_casts_lose_values_instead_of_failing(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,)], "a string")
    assert [r[0] for r in cast_to_schema(df, {"a": {"type": "int32"}}).collect()] == [1, None, None]
    assert count_lost(df, {"a": {"type": "int32"}}).first()["a"] == 1


def golden_schema():
    return {
        "required": ["schemas", "id", "collection", "geometry"],
        "collection": {"schemas": True, "id": False, "geometry": False, "bbox": False, "area": False, "perimeter": False},
        "properties": {"schemas": {"type": "object"}, "id": {"type": "string", "minLength": 1}, "collection": {"type": "string", "minLength": 1}, "geometry": {"type": "geometry", "geometryTypes": ["Point"]}, "bbox": {"type": "bounding-box"}, "area": {"type": "float", "exclusiveMinimum": 0, "maximum": 100000}, "perimeter": {"type": "float"}, "at": {"type": "date-time"}},
    }


def test_json_schema_document():
    s = golden_schema()
    doc = jsonschema.document(s, schema_id="https://example.com/schema.json")
    f = doc["$defs"]["feature_schemas"]["properties"]
    assert f["properties"]["properties"]["area"] == {"type": "number", "maximum": 100000, "exclusiveMinimum": 0}
    assert f["properties"]["properties"]["at"] == {"type": "string", "format": "date-time", "pattern": "Z$"}
    assert f["properties"]["not"] == {"required": ["schemas"]} and f["geometry"] == {"anyOf": [{"$ref": "https://geojson.org/schema/Point.json"}]}
    assert doc["$defs"]["feature_requirements"] == {"type": "object", "required": ["geometry", "id", "schemas"], "properties": {"properties": {"type": "object", "required": ["collection"]}}, "not": {"required": ["area", "perimeter"]}}
    assert len(doc["$defs"]["featurecollection_requirements"]["allOf"]) == 1 and doc["$id"]
    assert jsonschema.document(s) == jsonschema.document(s) and s == golden_schema()
    with pytest.raises(ValueError, match="no data type"):
        jsonschema.property_schema({"type": "nothing"})
    feature = {"type": "Feature", "schemas": {}, "id": "1", "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"collection": "a"}}
    assert jsonschema.validate(feature, doc) == []
    messages = lambda **x: [m for _, m in jsonschema.validate(feature | x, doc)]
    assert messages(id="") == ["'' should be non-empty"]
    assert messages(properties={"collection": "a", "area": 0}) == ["0 is less than or equal to the minimum of 0"]
    assert messages(properties={}) == ["'collection' is a required property"]
    assert messages(geometry={"type": "Polygon", "coordinates": []})
    missing = {k: v for k, v in feature.items() if k != "id"}
    assert [m for _, m in jsonschema.validate(missing, doc)] == ["'id' is a required property"]
    both = {"type": "FeatureCollection", "schemas": {}, "collection": "a", "features": [{k: v for k, v in feature.items() if k != "schemas"}]}
    assert jsonschema.validate(both, doc)


def test_schema_files():
    good = {"$schema": bundled.SDL, "properties": {"inspire:id": {"type": "string"}}}
    assert jsonschema.validate_schema(good) == []
    assert "'STRING' is not one of" in jsonschema.validate_schema({**good, "properties": {"inspire:id": {"type": "STRING"}}})[0][1]


def test_rules(spark):
    df = spark.createDataFrame([("ab", 5, [1, 1], {"k": 1}), (None, None, None, None), ("ABC", 1, [1, 2], {"j": 1})], "s string, n int, a array<int>, o map<string,int>").withColumn("id", F.monotonically_increasing_id())
    schema = {"s": {"type": "string", "pattern": "[A-Z]", "maxLength": 2}, "n": {"type": "int32", "minimum": 2, "enum": [5]}, "a": {"type": "array", "uniqueItems": True, "items": {"type": "int32"}}, "o": {"type": "object", "properties": {"k": {"type": "int32"}}, "minProperties": 2}, "gone": {"type": "string"}, "untyped": {}}
    got = {(r["column_name"], r["rule"]): r["violations"] for r in rules.count_violations(df, schema).collect()}
    assert got == {("s", "maxLength"): 1, ("s", "pattern"): 1, ("n", "minimum"): 1, ("n", "enum"): 1, ("a", "uniqueItems"): 1, ("o", "minProperties"): 2, ("o", "key:k"): 1}
    issues = rules.first_issues(df, {None: schema}, F.col("id"))
    assert "s: String 'ab' does not match the required pattern: [A-Z]." in issues and "n: Value 1 is less than the minimum allowed value of 2." in issues
    assert rules.first_issues(df, {None: {}}, F.col("id")) == [] and rules.count_violations(df, {}).count() == 0


def test_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, None, "x")], "a int, b string, c string")
    assert c.constants_of(df, df.columns) == {"b": None, "c": "x"} and c.constants_of(df.limit(1), df.columns) == {}
    assert c.drop_null_columns(df).columns == ["a", "c"]
    assert c.rename(df, {"a": "id", "zz": "y"}).columns == ["id", "b", "c"]
    with pytest.warns(UserWarning, match="not found"):
        assert c.map_columns(df, {"a": ["id", "code"], "zz": "y"}).columns == ["id", "code"]
    with pytest.raises(ValueError, match="Duplicate"):
        c.map_columns(df, {"a": "id", "c": "id"})
    assert c.filter_rows(df, {"b": lambda x: (x == "q", True)}).count() == 2 and c.filter_rows(df, {"b": lambda x: x == "q"}).count() == 0
    assert c.merge_projection(df.withColumnRenamed("a", "id"), ["c"], ["id"]).columns == ["c"]
    assert [r["id"] for r in c.index_as_id(spark.range(0, 10, 1, 3).withColumnRenamed("id", "v")).orderBy("v").collect()] == list(range(10))
    with pytest.raises(ValueError, match="country"):
        c.admin_columns("x1")
    assert [r["v"] for r in union([spark.createDataFrame([(1,)], "v int"), spark.createDataFrame([("a",)], "v string")]).collect()] == ["1", "a"]
    assert c.add_constants(df, {"l": [1, 2], "m": {"k": "v"}}).first()["l"] == [1, 2]


def test_text(spark):
    assert text.parse_link("Name <https://a.b>") == ("Name", "https://a.b") and text.parse_link("CC0") == ("CC0", None)
    assert text.format_filesize(1536) == "1.50 KB" and text.name_from_uri("https://a.b/c/d.zip?x=1") == "d.zip" and text.is_url("s3://b/k") and not text.is_url("/tmp")
    value = {"a": {"b": 1, "c": {}}, "d": [1, {"e": 2}]}
    assert text.flatten(value) == {"a.b": 1, "a.c": {}, "d": [1, {"e": 2}]} and text.nest(text.flatten(value)) == value
    assert text.flatten(value, sequences=True)["d.1.e"] == 2
    d = text.FlatDict(value)
    assert "a" in d and d["a"] == {"b": 1, "c": {}} and d["a.b"] == 1
    d["a.x"] = {"y": 3}
    del d["d"]
    d.set_delimiter(":")
    assert d.as_dict() == {"a": {"b": 1, "c": {}, "x": {"y": 3}}} and d["a:x:y"] == 3
    df = spark.createDataFrame([((1, (2,)), 3)], "a struct<b:int,c:struct<d:int>>, e int")
    assert text.flatten_structs(df).columns == ["a.b", "a.c.d", "e"]


def test_rename(tmp_path):
    (tmp_path / "README.md").write_text("# Template Extension\ntemplate:field in template-extension")
    (tmp_path / "x.bin").write_bytes(b"template:")
    assert rename.rename_extension(str(tmp_path), rename.replacements("My Crop", "crop")) == [str(tmp_path / "README.md")]
    assert (tmp_path / "README.md").read_text() == "# My Crop Extension\ncrop:field in my-crop-extension"


