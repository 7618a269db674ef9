"""The second part of the query catalogue: sources, sinks, schemas, validation and converters, through real files."""

from __future__ import annotations

import json
import zipfile
from collections.abc import Callable, Iterable, Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featurekit.functions import crs, text
from featurekit.functions import geometry as g
from featurekit.operators import columns as c
from featurekit.operators import rules
from featurekit.plans.queries import ORACLE, QUERIES, _boxes, _flat, _nations, _points, _violations, query, table
from featurekit.schema import algebra, bundled, jsonschema
from featurekit.schema.collection import Collection, dehydrate, merge_collections, parse_schemas, unique_schemas
from featurekit.sources import discover, geojson, geoparquet
from featurekit.table import FeatureTable

__all__ = ["CASES", "ORACLE", "QUERIES"]

HOST = "https://schemas.example.org"
ADMIN = f"{HOST}/administrative-division-extension/v0.1.0/schema.yaml"
INSPIRE = f"{HOST}/inspire-extension/v0.3.0/schema.yaml"


#: Cases of what the driver does with documents alone, and the SQL of their results: run by the tests, registered nowhere.
CASES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def case(sql: str):
    def keep(fn):
        CASES[fn.__name__] = fn, sql
        return fn

    return keep


def _folder(spark: SparkSession) -> Path:
    """A new folder for files that the driver writes."""
    path = Path(geoparquet.scratch_path(spark).removeprefix("file://").removeprefix("file:"))
    path.mkdir(parents=True)
    return path


def _said(spark: SparkSession, rows: Iterable[tuple[str, Any]]) -> DataFrame:
    """What driver-side operators give, as rows of JSON."""
    return spark.createDataFrame([(k, json.dumps(v, sort_keys=True, default=str)) for k, v in rows], "item string, result string")


def _values(rows: Mapping[str, Any]) -> str:
    quoted = ", ".join("('{}', '{}')".format(k.replace("'", "''"), json.dumps(v, sort_keys=True).replace("'", "''")) for k, v in rows.items())
    return f"SELECT * FROM (VALUES {quoted}) AS t(item, result)"


def _fails(fn, *args, **kwargs) -> str:
    """The kind of error a call ends with."""
    try:
        fn(*args, **kwargs)
    except Exception as e:  # the error is the result
        return type(e).__name__
    return "none"


def _nation_table(spark: SparkSession, d: str, **more: Any) -> FeatureTable:
    return FeatureTable(_nations(spark, d).coalesce(1).sortWithinPartitions(F.col("id").cast("int")), Collection({"schemas": {"nations": [bundled.CORE]}} | more))


def _geojson_file(spark: SparkSession, d: str, **more: Any) -> str:
    path = str(_folder(spark) / "nations.json")
    geojson.write_geojson(_nation_table(spark, d, **more), path)
    return path


_NATION = "SELECT CAST(n_nationkey AS VARCHAR) AS id, 'nations' AS collection, n_name AS name, CAST(n_nationkey * 4.0 - 50 AS DOUBLE) AS x, CAST(n_nationkey * 2.0 AS DOUBLE) AS y FROM nation"


# --- GeoJSON files ----------------------------------------------------------------------------------------------------


@query(_NATION)
def geojson_file_roundtrip(spark, d):
    """A FeatureCollection file, written and scanned."""
    return _flat(geojson.read_geojson(spark, _geojson_file(spark, d)).df)


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name FROM nation WHERE n_nationkey < 5")
def geojson_first_rows(spark, d):
    """The first rows and named properties only."""
    return geojson.read_geojson(spark, _geojson_file(spark, d), num=5, properties=["id", "name", "nothing"]).df


@query('SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS "place.name", CAST(n_regionkey AS BIGINT) AS "place.in.region" FROM nation')
def geojson_flattened(spark, d):
    """Nested properties as columns named by their path."""
    nested = F.struct(F.col("n_name").alias("name"), F.struct(F.col("n_regionkey").alias("region")).alias("in")).alias("place")
    df = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), nested, g.point(F.col("n_nationkey").cast("double"), F.lit(1.0)).alias("geometry"))
    path = str(_folder(spark) / "nested.json")
    geojson.write_geojson(FeatureTable(df), path, shrink=False)
    df, *_ = next(iter(discover.read_layers(spark, path, path)))
    return df.drop("geometry")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, 'All nations' AS title, 'CC0' AS license FROM nation")
def geojson_hydrated(spark, d):
    """Top-level members that features may hold become columns."""
    path = _geojson_file(spark, d, title="All nations", license="CC0")
    return geojson.read_geojson(spark, path, hydrate=True).df.select("id", "title", "license")


@query(_values({"collection": "nations", "schemas": {"nations": [bundled.CORE]}, "title": "All nations"}))
def geojson_metadata(spark, d):
    """Metadata without decoding features."""
    return _said(spark, geojson.metadata(spark, _geojson_file(spark, d, title="All nations")).items())


@query("SELECT CAST(n_nationkey AS VARCHAR) || '.json' AS file, CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, 'All nations' AS title FROM nation WHERE n_nationkey < 20")
def feature_files(spark, d):
    """K7, K8: one file per feature; metadata that features may hold go into their properties."""
    folder = str(_folder(spark))
    geojson.write_features(_nation_table(spark, d, title="All nations"), folder, num=20)
    read = spark.read.text(f"{folder}/*.json", wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.parse_json("value").alias("v"))
    return read.select("file", *(F.variant_get("v", p, "string").alias(n) for n, p in {"id": "$.id", "name": "$.properties.name", "title": "$.properties.title"}.items()))


@query("""SELECT s_suppkey, '{"type":"Feature","id":"' || s_suppkey || '","bbox":[0.0,1.0,2.0,3.0],"geometry":null,"properties":{' || CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE '"name":"' || s_name || '",' END || '"at":"2024-05-06T07:08:09Z"}}' AS feature FROM supplier""")
def feature_documents(spark, d):
    """Nulls are left out, boxes become arrays, times end in Z."""
    df = table(spark, d, "supplier").select("s_suppkey", F.col("s_suppkey").cast("string").alias("id"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_name")).alias("name"), F.lit("2024-05-06 07:08:09").cast("timestamp").alias("at"), F.struct(*(F.lit(float(i)).alias(n) for i, n in enumerate(("xmin", "ymin", "xmax", "ymax")))).alias("bbox"))
    return df.select("s_suppkey", geojson.feature_json(df.drop("s_suppkey")).alias("feature"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name FROM nation")
def geojson_lines(spark, d):
    """Newline-delimited features, written and read by all tasks."""
    path = f"{_folder(spark)}/lines.geojsonl"
    geojson.write_lines(_nation_table(spark, d), path)
    return geojson.read_geojson(spark, path, lines=True).df.select("id", "name")


# --- GeoParquet files -------------------------------------------------------------------------------------------------


def _parquet_file(spark: SparkSession, d: str, t: FeatureTable | None = None, **options: Any) -> str:
    path = str(_folder(spark) / "nations.parquet")
    geoparquet.write_geoparquet(t or _nation_table(spark, d), path, single_file=True, **options)
    return path


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name FROM nation WHERE n_nationkey < 7")
def geoparquet_first_rows(spark, d):
    """Named columns, of which one does not exist, and the first rows."""
    return geoparquet.read_geoparquet(spark, _parquet_file(spark, d), num=7, properties=["id", "name", "nothing"]).df


@query("SELECT p_partkey AS id, 0.0::DOUBLE AS xmin, 0.0::DOUBLE AS ymin, p_size::DOUBLE AS xmax, p_retailprice / 100 AS ymax FROM part")
def geoparquet_covering(spark, d):
    """K2: the covering column that the writer adds."""
    df = _boxes(spark, d).select(F.col("p_partkey").cast("string").alias("id"), F.col("p_size").alias("size"), F.lit("parts").alias("collection"), "geometry")
    path = geoparquet.scratch_path(spark)
    geoparquet.write_geoparquet(FeatureTable(df), path)
    return spark.read.parquet(path).select(F.col("id").cast("long").alias("id"), "bbox.*")


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey BETWEEN 20 AND 90 AND c_nationkey BETWEEN 3 AND 17")
def geoparquet_box(spark, d):
    """Rows in a box; of the files, only those are planned whose footers say that they may hold some."""
    df = table(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("id"),
        F.col("c_name").alias("name"),
        F.lit("customers").alias("collection"),
        g.point(F.col("c_custkey").cast("double"), F.col("c_nationkey").cast("double")).alias("geometry"),
    )
    path = geoparquet.scratch_path(spark)
    geoparquet.write_geoparquet(FeatureTable(df.repartitionByRange(8, F.col("id").cast("long"))), path)
    found = geoparquet.read_geoparquet(spark, path, box=(20.0, 3.0, 90.0, 17.0), properties=["id", "name"]).df
    return found.select(F.col("id").cast("long").alias("id"), "name")


_WRITTEN = [("1.0.0", "snappy"), ("1.1.0", "zstd"), ("1.1.0", "gzip"), ("1.1.0", None), ("9.9.9", "brotli")]


@query(" UNION ALL ".join(f"SELECT '{v}' AS wanted, '{'1.1.0' if v == '9.9.9' else v}' AS version, {repr(k) if k else 'NULL'} AS compression, count(*) AS n_rows, 1 AS n_groups, {'false' if v == '1.0.0' else 'true'} AS has_bbox, '[\"Point\"]' AS kinds FROM nation" for v, k in _WRITTEN))
def geoparquet_footers(spark, d):
    """Versions, codecs, counts and geometry types that footers state."""
    rows = []
    for version, codec in _WRITTEN:
        f = geoparquet.footer(_parquet_file(spark, d, version=version, compression=codec, level=None if codec != "zstd" else 3))
        rows.append((version, f.geo["version"], f.compression, f.rows, f.groups, "bbox" in f.schema.names, json.dumps(f.geo["columns"]["geometry"]["geometry_types"])))
    return spark.createDataFrame(rows, "wanted string, version string, compression string, n_rows bigint, n_groups int, has_bbox boolean, kinds string")


@query("SELECT count(*) AS n_rows, CAST(ceil(count(*) / 25000.0) AS BIGINT) AS n_groups FROM lineitem")
def geoparquet_row_groups(spark, d):
    """K5: row groups of at most 25,000 rows."""
    df = table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.lit("lines").alias("collection"), g.point(F.col("l_quantity"), F.col("l_discount")).alias("geometry"))
    path = geoparquet.scratch_path(spark)
    geoparquet.write_geoparquet(FeatureTable(df), path, compression="snappy", full=True)
    f = geoparquet.footer(path, spark)
    return spark.createDataFrame([(f.rows, f.groups)], "n_rows bigint, n_groups bigint")


@query(_values({"bbox": ["struct<xmin: double, ymin: double, xmax: double, ymax: double>", "null"], "collection": ["string"], "geometry": ["binary"], "id": ["string"], "name": ["string", "null"]}))
def geoparquet_columns(spark, d):
    """Types of columns, with null where it is allowed."""
    return _said(spark, geoparquet.column_types(geoparquet.footer(_parquet_file(spark, d))).items())


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, 'All nations' AS title FROM nation")
def geoparquet_hydrated(spark, d):
    """A constant goes to the footer when written, and comes back when read."""
    t = _nation_table(spark, d)
    path = _parquet_file(spark, d, t.with_(df=t.df.withColumn("title", F.lit("All nations"))))
    assert "title" not in geoparquet.footer(path).schema.names
    return geoparquet.read_geoparquet(spark, path, hydrate=True).df.select("id", "title")


# --- constants, columns, geometry -------------------------------------------------------------------------------------


@query("SELECT * FROM (SELECT 'kept' AS place, unnest(['l_orderkey', 'l_linenumber', 'l_returnflag', 'collection']) AS item, NULL AS result UNION ALL SELECT 'moved', 'unit', '\"kg\"' UNION ALL SELECT 'moved', 'note', 'null' UNION ALL SELECT 'moved', 'collection', '\"lines\"')")
def dehydrated(spark, d):
    """Columns of one value, null included, go to the metadata."""
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag").withColumns({"unit": F.lit("kg"), "note": F.lit(None).cast("string"), "collection": F.lit("lines")})
    t = dehydrate(FeatureTable(df))
    rows = [("kept", n, None) for n in t.columns] + [("moved", k, json.dumps(v)) for k, v in t.collection.items()]
    return spark.createDataFrame(rows, "place string, item string, result string")


@query("SELECT row_number() OVER () - 1 AS id, o_orderkey FROM orders")
def index_as_id(spark, d):
    """Rows numbered in the order of their file."""
    return c.index_as_id(table(spark, d, "orders").select("o_orderkey"))


@query(_values({"same": "ValueError", "different": "none"}))
def duplicate_columns(spark, d):
    """Two columns may not end up with one name."""
    df = table(spark, d, "nation")
    return _said(spark, [("same", _fails(c.map_columns, df, {"n_name": "id", "n_nationkey": "id"})), ("different", _fails(c.map_columns, df, {"n_name": "name", "n_nationkey": "id"}))])


@query("SELECT p_partkey, round(CASE p_partkey % 3 WHEN 0 THEN p_size * p_size / 2.0 ELSE CAST(p_size * p_size AS DOUBLE) END, 6) AS area, CASE p_partkey % 3 WHEN 0 THEN 'MultiPolygon' ELSE 'Polygon' END AS kind, true AS valid FROM part WHERE p_size > 0")
def make_valid_area(spark, d):
    """A bow-tie becomes its two triangles, a hole's ring that turns the wrong way and repeated points stay harmless."""
    from featurekit.functions.validity import is_valid, make_valid

    s, zero = F.col("p_size").cast("double"), F.lit(0.0)
    bow = g.polygon(g.ring((zero, zero), (s, s), (s, zero), (zero, s), (zero, zero)))
    twice = g.polygon(g.ring((zero, zero), (s, zero), (s, zero), (s, s), (zero, s), (zero, zero)))
    shape = F.when(F.col("p_partkey") % 3 == 0, bow).when(F.col("p_partkey") % 3 == 1, twice).otherwise(g.rectangle(zero, zero, s, s))
    # Few row groups would be few tasks, however many rows they have.
    rows = table(spark, d, "part").filter("p_size > 0").select("p_partkey", "p_size").repartition(4 * spark.sparkContext.defaultParallelism)
    df = rows.select("p_partkey", make_valid(shape).alias("geometry"))
    return df.select("p_partkey", F.round(g.area(F.col("geometry")), 6).alias("area"), g.geometry_type(F.col("geometry")).alias("kind"), is_valid(F.col("geometry")).alias("valid"))


@query(_violations("part", {("geometry", "geometryTypes"): "p_partkey % 5 = 0", ("geometry", "validity"): "p_partkey % 5 <> 0 AND p_partkey % 3 = 0 AND p_size > 0"}, "part"))
def validate_geometry(spark, d):
    """Types that a schema allows, and validity."""
    s, zero = F.col("p_size").cast("double"), F.lit(0.0)
    bow = g.polygon(g.ring((zero, zero), (s, s), (s, zero), (zero, s), (zero, zero)))
    shape = F.when(F.col("p_partkey") % 5 == 0, g.point(s, zero)).when(F.col("p_partkey") % 3 == 0, bow).otherwise(g.rectangle(zero, zero, s + 1, s + 1))
    return rules.count_violations(table(spark, d, "part").select(shape.alias("geometry")), {"geometry": {"type": "geometry", "geometryTypes": ["Polygon"]}})


@query("SELECT CASE WHEN p_partkey % 2 = 0 THEN 'Self-intersection' END AS reason, count(*) AS n FROM part WHERE p_size > 0 GROUP BY 1")
def invalid_reasons(spark, d):
    """Why geometries are not valid."""
    from featurekit.functions.validity import invalid_reason

    s, zero = F.col("p_size").cast("double"), F.lit(0.0)
    bow = g.polygon(g.ring((zero, zero), (s, s), (s, zero), (zero, s), (zero, zero)))
    shape = F.when(F.col("p_partkey") % 2 == 0, bow).otherwise(g.rectangle(zero, zero, s, s))
    df = table(spark, d, "part").filter("p_size > 0").select(F.regexp_replace(invalid_reason(shape), r"\[.*", "").alias("reason"))
    return df.groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 6) AS x, round(CAST(embedding[2] AS DOUBLE), 6) AS y, vec_id % 2 = 0 AS had_z, false AS has_z FROM embeddings")
def drop_z(spark, d):
    """Third coordinates are found and dropped."""
    e = F.col("embedding")
    flat, high = (F.transform(F.slice(e, 1, n), lambda v: v.cast("double")) for n in (2, 3))
    shape = g.geometry(F.lit("Point"), F.array(F.array(F.array(F.when(F.col("vec_id") % 2 == 0, high).otherwise(flat)))))
    df = table(spark, d, "embeddings").select("vec_id", shape.alias("geometry")).withColumn("low", g.drop_z(F.col("geometry")))
    p = F.col("low")["parts"][0][0][0]
    return df.select("vec_id", F.round(p[0], 6).alias("x"), F.round(p[1], 6).alias("y"), g.has_z(F.col("geometry")).alias("had_z"), g.has_z(F.col("low")).alias("has_z"))


@query("SELECT round(min(CAST(embedding[3] AS DOUBLE)), 6) AS xmin, round(max(CAST(embedding[4] AS DOUBLE)), 6) AS ymax FROM embeddings")
def active_geometry(spark, d):
    """A table of two geometry columns, measured by the second one."""
    e = F.col("embedding")
    t = FeatureTable(_points(spark, d).join(table(spark, d, "embeddings"), "vec_id").withColumn("other", g.point(e[2].cast("double"), e[3].cast("double")))).with_(geometry="other")
    return g.total_bounds(t.df, t.geometry).select(F.round("xmin", 6).alias("xmin"), F.round("ymax", 6).alias("ymax"))


@query("SELECT p_partkey AS id, round(p_size * p_retailprice / 100, 4) AS area, 'https://schemas.example.org/geometry-metrics-extension/v0.1.0/schema.yaml' AS extension FROM part")
def improved(spark, d):
    """Renamed, measured, and the extension of the measures is registered."""
    from featurekit.operators.improve import improve

    df = _boxes(spark, d).select("p_partkey", "geometry")
    t = improve(FeatureTable(df, Collection({"schemas": {"parts": [bundled.CORE]}}), "EPSG:3857"), rename={"p_partkey": "id"}, sizes=True)
    extension = next(u for u in t.collection.schemas["parts"] if "metrics" in u)
    return t.df.select("id", F.round("metrics:area", 4).alias("area"), F.lit(extension).alias("extension"))


_Q = "((1 - {e2!r}) * (sin({0}) / (1 - {e2!r} * sin({0}) * sin({0})) - ln((1 - {e!r} * sin({0})) / (1 + {e!r} * sin({0}))) / (2 * {e!r})))"
_R, _S, _C, _D = crs.grid(3035).turn


@query(f"""WITH p AS (SELECT vec_id, radians(CAST(embedding[1] AS DOUBLE) * 10) AS lam, radians(52 + CAST(embedding[2] AS DOUBLE) * 10) AS phi FROM embeddings),
b AS (SELECT vec_id, lam, asin({_Q.format("phi", e=crs.E, e2=crs.E2)} / {crs.QP!r}) AS beta FROM p),
k AS (SELECT *, {_R!r} * sqrt(2 / (1 + {_S!r} * sin(beta) + {_C!r} * cos(beta) * cos(lam))) AS k FROM b)
SELECT vec_id, round(4321000 + k * {_D!r} * cos(beta) * sin(lam), 2) AS x, round(3210000 + k / {_D!r} * ({_C!r} * sin(beta) - {_S!r} * cos(beta) * cos(lam)), 2) AS y FROM k""")
def reproject_europe(spark, d):
    """G1: an azimuthal equal-area grid; back again it is where it was."""
    e = F.col("embedding")
    df = table(spark, d, "embeddings").select("vec_id", g.point(e[0].cast("double") * 10 + 10, e[1].cast("double") * 10 + 52).alias("geometry"))
    there = crs.reproject(F.col("geometry"), 4258, 3035)
    back = crs.reproject(crs.reproject(there, 3035, 3006), 3006, 3035)["parts"][0][0][0]
    return df.select("vec_id", F.round(back[0], 2).alias("x"), F.round(back[1], 2).alias("y"))


_CELL = "least(greatest(floor(({0} + {1}) / {2} * 65536), 0), 65535)::BIGINT"
#: The curve in 16 steps: a quadrant's share of the distance, then the turn of what lies within it.
ORACLE["hilbert_order"] = f"""WITH RECURSIVE p AS (SELECT vec_id, {_CELL.format("CAST(embedding[1] AS DOUBLE) * 180", 180.0, 360.0)} AS x, {_CELL.format("CAST(embedding[2] AS DOUBLE) * 80", 90.0, 180.0)} AS y FROM embeddings),
h(vec_id, s, x, y, key) AS (SELECT vec_id, 32768::BIGINT, x, y, 0::BIGINT FROM p UNION ALL
SELECT vec_id, s // 2,
 CASE WHEN y & s > 0 THEN x WHEN x & s > 0 THEN 65535 - y ELSE y END, CASE WHEN y & s > 0 THEN y WHEN x & s > 0 THEN 65535 - x ELSE x END,
 key + s * s * (CASE WHEN x & s > 0 AND y & s > 0 THEN 2 WHEN x & s > 0 THEN 3 WHEN y & s > 0 THEN 1 ELSE 0 END) FROM h WHERE s > 0)
SELECT vec_id, key FROM h WHERE s = 0"""


# --- values, text, dates ----------------------------------------------------------------------------------------------


@query(_violations("events", {("props", "minProperties"): "event_id % 4 = 0", ("props", "maxProperties"): "event_id % 4 = 3", ("props", "key:a"): "event_id % 4 = 0", ("props", "key:b"): "event_id % 4 IN (0, 1)"}, "events"))
def validate_objects(spark, d):
    """Numbers of keys, and keys that must be there."""
    pair = lambda k: F.struct(F.lit(k).alias("key"), F.lit(1).alias("value"))
    props = F.map_from_entries(F.slice(F.array(*map(pair, "abc")), F.lit(1), (F.col("event_id") % 4).cast("int")))
    wanted = {"props": {"type": "object", "minProperties": 1, "maxProperties": 2, "properties": {"a": {"type": "int32"}, "b": {"type": "int32"}}}}
    return rules.count_violations(table(spark, d, "events").select(props.alias("props")), wanted)


@query("SELECT page_id, split_part(rtrim(regexp_extract(url, '^[^?#]*'), '/'), '/', -1) AS name FROM pages")
def uri_names(spark, d):
    """The last part of an address's path."""
    return table(spark, d, "pages").select("page_id", text.uri_name(F.col("url")).alias("name"))


@query("SELECT o_orderkey, strptime(strftime(o_orderdate, '%d.%m.%Y'), '%d.%m.%Y') AS day, o_orderkey % 2 = 1 AS lost FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, NULL, true FROM orders WHERE o_orderkey % 2 = 1")
def date_parsing(spark, d):
    """Dates by a pattern; what does not fit is null, not an error."""
    df = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "dd.MM.yyyy")).otherwise("on a day").alias("day"))
    df = c.migrate_columns(df, {"day": lambda x: F.try_to_timestamp(x, F.lit("d.M.yyyy")).cast("timestamp_ntz")})
    return df.withColumn("lost", F.col("day").isNull())


@query("SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS INT) AS TINYINT) AS small, CASE WHEN l_linenumber = 1 THEN NULL ELSE CAST(l_linenumber AS INT) END AS number FROM lineitem")
def schema_casts(spark, d):
    """Types of a schema; values that do not fit are null."""
    from featurekit.types import cast_to_schema

    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("small"), F.when(F.col("l_linenumber") == 1, "one").otherwise(F.col("l_linenumber").cast("string")).alias("number"))
    return cast_to_schema(df, {"small": {"type": "int8"}, "number": {"type": "int32"}})


@case(_values({"0": "0.00 B", "1023": "1023.00 B", "1024": "1.00 KB", "1572864": "1.50 MB", "5368709120": "5.00 GB", "1125899906842624": "1.00 PB"}))
def file_sizes(spark, d):
    """D2."""
    return _said(spark, [(str(n), text.format_filesize(n)) for n in (0, 1023, 1024, 1572864, 5368709120, 1125899906842624)])


@case(_values({"flat": {"a.b": 1, "a.c.d": [2, 3], "e": {}}, "get": {"d": [2, 3]}, "set": {"a": {"b": 1, "c": 5}, "e": {}}, "deleted": {"e": {}}, "contains": [True, True, False], "slash": {"a/b": 1, "a/c/d": [2, 3], "e": {}}, "sequences": {"a.b": 1, "a.c.d.0": 2, "a.c.d.1": 3, "e": {}}}))
def nested_keys(spark, d):
    """A nested mapping read, set and deleted by joined keys."""
    value = {"a": {"b": 1, "c": {"d": [2, 3]}}, "e": {}}
    flat, changed, less, other = (text.FlatDict(value) for _ in range(4))
    changed["a.c"] = 5
    del less["a"]
    other.set_delimiter("/")
    return _said(spark, [("flat", dict(flat.items())), ("get", flat["a.c"]), ("set", changed.as_dict()), ("deleted", dict(less.items())), ("contains", ["a.b" in flat, "a.c" in flat, "b" in flat]), ("slash", dict(other.items())), ("sequences", text.flatten(value, sequences=True))])


@case(_values({"0.1.0": True, "0.1.9": True, "0.2.0": False, "0.0.9": False, "1": False}))
def version_ranges(spark, d):
    """Versions of the specification that are supported."""
    return _said(spark, [(v, bundled.version_matches(v, bundled.SPECIFICATION)) for v in ("0.1.0", "0.1.9", "0.2.0", "0.0.9", "1")])


@case(_values({"README.md": "# Soil Extension\nsoil:depth", "data.bin": "Template Extension"}))
def renamed_extension(spark, d):
    """Replacements over the text files of a folder; other files stay."""
    from featurekit.rename import rename_extension, replacements

    folder = _folder(spark)
    (folder / "README.md").write_text("# Template Extension\ntemplate:depth")
    (folder / "data.bin").write_text("Template Extension")
    rename_extension(str(folder), replacements("Soil", "soil"))
    return _said(spark, [(p.name, p.read_text()) for p in sorted(folder.iterdir())])


@case(_values({"0": "a:", "1": "  b: 1", "2": "  c:", "3": "    (omitted, 2 items)", "4": "d: none", "5": "e:", "6": "  - a lo...", "7": "  - 2"}))
def pretty_lines(spark, d):
    """Nested values as lines, deep ones omitted, long ones cut."""
    from featurekit.describe import pretty

    return _said(spark, [(str(i), line) for i, line in enumerate(pretty({"a": {"b": 1, "c": {"x": 1, "y": 2}}, "d": {}, "e": ["a long text", 2]}, most=2, width=7))])


# --- schemas ----------------------------------------------------------------------------------------------------------

_LEFT = {"required": ["x"], "collection": {"x": False}, "properties": {"x": {"type": "string", "enum": ["a", "b"], "minLength": 1, "maxLength": 9}}}
_RIGHT = {"required": ["y"], "properties": {"x": {"type": "string", "enum": ["b", "c"], "minLength": 2, "maxLength": 5}, "y": {"type": "int8"}}}


@case(_values({"required": ["x", "y"], "collection": {"x": False}, "x": {"type": "string", "enum": ["b"], "minLength": 2, "maxLength": 5}, "y": {"type": "int8"}, "strict": "ValueError", "all": ["x", "y"], "conflicts": ["properties", "required"]}))
def schema_merge(spark, d):
    """What holds where both schemas hold; a strict merge takes no difference."""
    m = algebra.merge(_LEFT, _RIGHT)
    whole = algebra.merge_all([{}, _LEFT, _RIGHT, _LEFT])
    return _said(spark, [("required", m["required"]), ("collection", m["collection"]), *m["properties"].items(), ("strict", _fails(algebra.merge, _LEFT, _RIGHT, True)), ("all", sorted(whole["properties"])), ("conflicts", algebra.conflicts(_LEFT, _RIGHT))])


@case(_values({"required": ["z"], "collection": {"z": False}, "properties": ["z"]}))
def schema_pick(spark, d):
    """Some properties of a schema, renamed."""
    s = algebra.pick(_LEFT | {"properties": _LEFT["properties"] | {"other": {"type": "string"}}}, ["x"], {"x": "z"})
    return _said(spark, [("required", s["required"]), ("collection", s["collection"]), ("properties", sorted(s["properties"]))])


@case(_values({"version": "0.1.0", "core": bundled.CORE, "extensions": [ADMIN, INSPIRE], "required": ["admin:country_code"], "mapped": ["depth"], "missing": "FileNotFoundError", "map": ["https://a.example.org/s.yaml"], "no_map": "ValueError"}))
def schema_resolution(spark, d):
    """Schemas by their addresses, from the bundle, a map and files."""
    path = _folder(spark) / "s.yaml"
    path.write_text("properties:\n  depth:\n    type: float\n")
    version, core, extensions = parse_schemas([INSPIRE, bundled.CORE, ADMIN])
    mapped = bundled.parse_schema_map([f"https://a.example.org/s.yaml,{path}"])
    own = algebra.resolve(["https://a.example.org/s.yaml"], mapped)["https://a.example.org/s.yaml"]
    found = [("version", version), ("core", core), ("extensions", extensions), ("required", algebra.resolve([ADMIN])[ADMIN]["required"]), ("mapped", sorted(own["properties"]))]
    return _said(spark, [*found, ("missing", _fails(algebra.resolve, ["https://a.example.org/t.yaml"])), ("map", sorted(mapped)), ("no_map", _fails(bundled.parse_schema_map, ["nothing"]))])


@case(_values({"added": [ADMIN, bundled.CORE], "removed": [bundled.CORE], "unique": [ADMIN, INSPIRE, bundled.CORE], "only_here": ["schemas", "schemas:custom"], "context_of_id": False, "merged": {"a": [ADMIN, bundled.CORE], "b": [INSPIRE]}, "custom": ["p"]}))
def collection_metadata(spark, d):
    """Schemas of collections added, removed, gathered and merged."""
    a, b = Collection({"schemas": {"a": [bundled.CORE]}}), Collection({"schemas": {"b": [INSPIRE]}, "schemas:custom": {"properties": {"p": {"type": "string"}, "q": {"type": "string"}}}})
    more = a.add_schema(ADMIN)
    both = merge_collections([a, b, more], ["p"])
    rows = [("added", sorted(more.schemas["a"])), ("removed", sorted(more.remove_schema(ADMIN).schemas["a"])), ("unique", sorted(unique_schemas(merge_collections([b, more])))), ("only_here", sorted(a.only_here())), ("context_of_id", a.context()["id"])]
    return _said(spark, [*rows, ("merged", both["schemas"]), ("custom", sorted(both["schemas:custom"]["properties"]))])


@case(_values({"area": {"type": "number", "exclusiveMinimum": 0, "maximum": 9}, "at": {"type": "string", "format": "date-time", "pattern": "Z$"}, "code": {"type": "integer", "minimum": 1, "maximum": 255}, "shape": {"anyOf": [{"$ref": "https://geojson.org/schema/Point.json"}]}, "tags": {"type": "array", "items": {"type": "string", "minLength": 1}}, "who": {"type": "object", "properties": {"name": {"type": "string"}}, "required": ["name"]}, "unknown": "ValueError"}))
def json_schema_properties(spark, d):
    """M8: properties as JSON Schema."""
    props = {"area": {"type": "float", "exclusiveMinimum": 0, "maximum": 9}, "at": {"type": "date-time"}, "code": {"type": "uint8", "minimum": 1}, "shape": {"type": "geometry", "geometryTypes": ["Point"]}, "tags": {"type": "array", "items": {"type": "string", "minLength": 1}}, "who": {"type": "object", "required": ["name"], "properties": {"name": {"type": "string"}}}}
    return _said(spark, [*((k, jsonschema.property_schema(v)) for k, v in props.items()), ("unknown", _fails(jsonschema.property_schema, {"type": "colour"}))])


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN '[\"''id'' is a required property\"]' WHEN c_custkey % 4 = 1 THEN '[\"''collection'' is a required property\"]' ELSE '[]' END AS problems FROM customer")
def json_schema_documents(spark, d):
    """Features against the JSON Schema of a collection's schemas."""
    schema = algebra.merge_all([*algebra.resolve([bundled.CORE]).values()])
    document = jsonschema.document({**schema, "required": [r for r in schema["required"]], "collection": {}})

    def problems(batches):
        for b in batches:
            out = []
            for i in b["id"]:
                f = {"type": "Feature", "id": str(i), "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"collection": "x"}}
                if i % 4 == 0:
                    del f["id"]
                if i % 4 == 1:
                    del f["properties"]["collection"]
                out.append(json.dumps([m for _, m in jsonschema.validate(f, document)]))
            yield b.assign(problems=out)

    return table(spark, d, "customer").select(F.col("c_custkey").alias("id")).mapInPandas(problems, "id bigint, problems string")


@case(_values({"good": 0, "bad": 1}))
def metaschema(spark, d):
    """A schema file against the language's own schema."""
    schema = lambda kind: {"$schema": bundled.SDL, "properties": {"a": {"type": kind}}}
    return _said(spark, [(n, len(jsonschema.validate_schema(schema(k)))) for n, k in (("good", "string"), ("bad", "STRING"))])


@query("SELECT 'bbox' AS item, '[' || CAST(min(n_nationkey * 4.0 - 50) AS DOUBLE) || ', ' || CAST(min(n_nationkey * 2.0) AS DOUBLE) || ', ' || CAST(max(n_nationkey * 4.0 - 50) AS DOUBLE) || ', ' || CAST(max(n_nationkey * 2.0) AS DOUBLE) || ']' AS result FROM nation UNION ALL " + _values({"id": "nations", "providers": [{"name": "Bureau", "roles": ["producer", "licensor"], "url": "https://bureau.example.org"}], "license": "CC0-1.0", "interval": [["2020-01-01T00:00:00Z", "2020-01-01T00:00:00Z"]], "type": "application/geo+json", "none": "ValueError"}))
def stac_document(spark, d):
    """A STAC Collection of a table."""
    from featurekit.stac import collection_document

    t = _nation_table(spark, d, description="All nations", license="CC0-1.0", provider="Bureau <https://bureau.example.org>", since="2020-01-01T00:00:00Z")
    doc = collection_document(t, "https://bureau.example.org/n.json", "application/geo+json", "since")
    rows = {"id": doc["id"], "providers": doc["providers"], "license": doc["license"], "interval": doc["extent"]["temporal"]["interval"], "type": doc["assets"]["data"]["type"], "none": _fails(collection_document, _nation_table(spark, d), "x"), "bbox": doc["extent"]["spatial"]["bbox"][0]}
    return _said(spark, rows.items())


# --- validation of files ----------------------------------------------------------------------------------------------


@query(_values({"good.parquet": [], "missing.parquet": ["FileNotFoundError"], "plain.parquet": ["No valid geo metadata found"], "required.parquet": ["admin:country_code: Required column is missing"], "values.parquet": ["admin:country_code: String 'NATION' is longer than the maximum length of 2.", "admin:country_code: String 'NATION' does not match the required pattern: ^[A-Z]{2}$."], "wanted.parquet": [f"Collection 'nations': Required schema {INSPIRE} not found"], "core.parquet": ["Collection 'nations': No core schema found"]}))
def validate_files(spark, d):
    """Files that are missing, plain, incomplete, or hold values that break a rule."""
    from featurekit.plans.validate import validate

    t, out = _nation_table(spark, d), []
    with_admin = t.with_(collection=Collection({"schemas": {"nations": [bundled.CORE, ADMIN]}}))
    country = lambda v: with_admin.with_(df=t.df.withColumn("admin:country_code", v))
    tables = {"good": country(F.upper(F.substring("name", 1, 2))), "required": with_admin, "values": country(F.when(F.col("id") == "7", "NATION").otherwise("DE")), "core": t.with_(collection=Collection({"schemas": {"nations": [INSPIRE]}}), df=t.df.withColumn("inspire:id", F.concat(F.lit("https://x.example.org/"), "id")))}
    tables["wanted"] = t
    for name, x in tables.items():
        path = _parquet_file(spark, d, x)
        out.append((f"{name}.parquet", validate(spark, path, required=[INSPIRE] if name == "wanted" else []).errors))
    plain = geoparquet.scratch_path(spark) + ".parquet"
    t.df.drop("geometry").write.parquet(plain)
    out.append(("plain.parquet", validate(spark, plain).errors))
    gone = validate(spark, "/nowhere/gone.parquet")
    return _said(spark, [*out, ("missing.parquet", ["FileNotFoundError"] if not gone.is_valid() else [])])


@case(_values({"unit": ["at: Timestamp unit should be milliseconds"], "zone": ["at: Timezone must be UTC"], "nulls": ["id: Nullability is True, but must be False"], "type": ["size: Type is string, but must be int32"], "key": ["props: Map keys must be strings"], "geometry": ["geometry: Geometry types are ['Point'], expected ['Polygon']"], "unknown": ["other: No schema defined"], "untyped": ["loose: No type specified"]}))
def validate_structure(spark, d):
    """What footers say against what schemas ask for."""
    import pyarrow as pa

    from featurekit.plans.validate import Result, _structure

    props = {"id": {"type": "string"}, "at": {"type": "date-time"}, "size": {"type": "int32"}, "props": {"type": "object"}, "geometry": {"type": "geometry", "geometryTypes": ["Polygon"]}, "loose": {}}
    ok = {"id": pa.field("id", pa.string(), False)}
    cases = {"unit": pa.field("at", pa.timestamp("us", "UTC")), "zone": pa.field("at", pa.timestamp("ms")), "nulls": pa.field("id", pa.string()), "type": pa.field("size", pa.string()), "key": pa.field("props", pa.map_(pa.int32(), pa.int32())), "geometry": pa.field("geometry", pa.binary()), "unknown": pa.field("other", pa.int32()), "untyped": pa.field("loose", pa.int32())}
    out = []
    for name, field in cases.items():
        r = Result()
        fields = list((ok | {field.name: field}).values())
        geo = {"columns": {"geometry": {"geometry_types": ["Point"]}}}
        _structure(r, geoparquet.Footer(geo, Collection(), pa.schema(fields), 1, 1, len(fields), None, 1), {"required": ["id"], "properties": props}, set(), True)
        out.append((name, r.errors + r.warnings))
    return _said(spark, out)


@case(_values({"mapping": ["No valid geo metadata found"], "version": ["geo: unsupported version 0.4.0"], "column": ["geo: the primary column is not described"], "encoding": ["geo: column geometry: unsupported encoding point"], "types": ["geo: column geometry: geometry_types is missing"], "good": []}))
def validate_geo_footer(spark, d):
    """What a geo footer lacks."""
    from featurekit.plans.validate import _geo_problems

    good = {"version": "1.1.0", "primary_column": "geometry", "columns": {"geometry": {"encoding": "WKB", "geometry_types": ["Point"]}}}
    column = lambda **x: good | {"columns": {"geometry": {k: v for k, v in ({"encoding": "WKB", "geometry_types": []} | x).items() if v is not None}}}
    cases = {"mapping": None, "version": good | {"version": "0.4.0"}, "column": good | {"primary_column": "shape"}, "encoding": column(encoding="point"), "types": column(geometry_types=None), "good": good}
    return _said(spark, [(k, list(_geo_problems(v))) for k, v in cases.items()])


@query("SELECT 'partial' AS item, '[\"Only the first 5 of ' || count(*) || ' rows were validated\"]' AS result FROM nation UNION ALL SELECT 'whole', '[]'")
def validate_partially(spark, d):
    """A notice where only some rows were looked at."""
    from featurekit.plans.validate import validate

    path = _parquet_file(spark, d)
    only = lambda num: [w for w in validate(spark, path, num=num).warnings if w.startswith("Only")]
    return _said(spark, [("partial", only(5)), ("whole", only(-1))])


@query("SELECT CAST(n_nationkey AS VARCHAR) AS item, '\"' || CAST(n_nationkey AS VARCHAR) || '.5 is not of type ''string''\"' AS result FROM nation WHERE n_nationkey % 10 = 3")
def validate_geojson_types(spark, d):
    """Features of a file against their collection's schemas, all messages."""
    from featurekit.plans.validate import validate

    t = _nation_table(spark, d)
    t = t.with_(df=t.df.drop("name"), collection=Collection({"schemas": {"nations": [bundled.CORE, INSPIRE]}}))
    path = str(_folder(spark) / "typed.json")
    features = [json.loads(r["f"]) for r in t.df.select(geojson.feature_json(t.df).alias("f")).collect()]  # 25 nations
    for f in features:
        n = int(f["id"])
        f["properties"]["inspire:id"] = n + 0.5 if n % 10 == 3 else f"https://x.example.org/{n}"
    Path(path).write_text(json.dumps({"type": "FeatureCollection", "schemas": t.collection["schemas"], "features": features}))
    errors = [e.rpartition(": ")[2] for e in validate(spark, path, num=-1).errors]
    return _said(spark, [(e.partition(".")[0], e) for e in errors])


# --- inputs and converters --------------------------------------------------------------------------------------------


@case(_values({"a.json": "geojson", "a.geojson": "geojson", "a.parquet": "geoparquet", "a.GEOJSON": "ValueError", "folder": ["a.json", "b.PARQUET"], "input": ["a.zip", ["b", "c"]], "sources": {"x/a.zip": "a.zip"}, "variant": "ValueError", "cache": True}))
def inputs(spark, d):
    """Formats, folders, archives with members, variants."""
    folder = _folder(spark)
    for n in ("a.json", "b.PARQUET", "collection.json", "c.txt"):
        (folder / n).write_text("{}")
    kind = lambda p: discover.encoding_of(p) if _fails(discover.encoding_of, p) == "none" else _fails(discover.encoding_of, p)
    rows = [(p, kind(p)) for p in ("a.json", "a.geojson", "a.parquet", "a.GEOJSON")]
    rows += [("folder", [Path(p).name for p in discover.expand(folder)]), ("input", list(discover.parse_input("a.zip|b, c"))), ("sources", discover.choose_sources(None, {"2020": "x/a.zip"}, None))]
    return _said(spark, [*rows, ("variant", _fails(discover.choose_sources, None, {"2020": "a"}, "2021")), ("cache", discover.cache_folder(str(folder / "cache")).is_dir())])


@query("SELECT r_regionkey AS id, r_name AS name FROM region UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def archive_members(spark, d):
    """Members of an archive, unpacked once, united."""
    from featurekit.operators.union import union

    folder = _folder(spark)
    region = table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    nation = table(spark, d, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    with zipfile.ZipFile(folder / "all.zip", "w") as z:
        for name, df in {"region": region, "nation": nation, "unwanted": region}.items():
            z.writestr(f"in/{name}.csv", "id,name\n" + "".join(f"{r['id']},{r['name']}\n" for r in df.collect()))  # some 30 rows
    found = discover.download({str(folder / "all.zip"): ["in/region.csv", "in/nation.csv"]}, str(folder / "cache"))
    return union([df.select(F.col("id").cast("int").alias("id"), "name") for path, uri in found for df, *_ in discover.read_layers(spark, path, uri)])


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, CAST(p_partkey AS VARCHAR) AS code, round(p_size * 0.0001, 8) AS hectares, 'SE' AS \"admin:country_code\", 'se_parts' AS collection, 'from file' AS note FROM part WHERE p_size > 0 AND p_partkey % 3 <> 0")
def converted(spark, d):
    """A converter from file to table."""
    from featurekit.plans.convert import AdminConverter

    s, zero = F.col("p_size").cast("double"), F.lit(0.0)
    raw = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("key"), "p_size", (F.col("p_partkey") % 3).alias("kind"), g.rectangle(zero, zero, s, s).alias("geometry"))
    path = geoparquet.scratch_path(spark) + ".parquet"
    geoparquet.write_geoparquet(FeatureTable(raw.filter("p_size > 0").withColumns({"id": F.col("key"), "collection": F.lit("x")})), path, shrink=False)

    class Parts(AdminConverter):
        id = "se_parts"
        title = "Parts"
        columns = {"geometry": "geometry", "key": ["id", "code"], "p_size": "hectares", "note": "note"}
        column_filters = {"kind": lambda k: (k.isin(0), True)}
        column_migrations = {"p_size": lambda x: F.round(x * 0.0001, 8)}

        def file_migration(self, df, path, uri, layer):
            return df.withColumn("note", F.lit("from file"))

        def migrate(self, df):
            return df.drop("id", "collection", "bbox")

    t = Parts().convert(spark, {path: "parts.parquet"})
    assert t.collection["title"] == "Parts" and t.collection.schemas["se_parts"] >= {bundled.CORE, Parts.admin_schema}
    return t.df.drop("geometry")


@case(_values({"good": "x", "broken": "SyntaxError", "empty": "ValueError", "template": "absent"}))
def converter_plugins(spark, d):
    """H1: converter classes of a package; a broken module does not hide the others."""
    import sys

    from featurekit.plans import convert

    folder = _folder(spark) / f"plugins_{abs(hash(geoparquet.scratch_path(spark)))}"
    folder.mkdir()
    files = {"__init__": "", "good": "from featurekit.plans.convert import Converter\nclass C(Converter):\n    id = 'x'\n", "broken": "def (:\n", "empty": "", "template": "class T: pass\n"}
    for name, code in files.items():
        (folder / f"{name}.py").write_text(code)
    sys.path.insert(0, str(folder.parent))
    try:
        found = convert.discover(folder.name)
    finally:
        sys.path.remove(str(folder.parent))
    return _said(spark, [(n, "absent" if n not in found else type(found[n]).__name__ if isinstance(found[n], Exception) else found[n].id) for n in ("good", "broken", "empty", "template")])


@case(_values({"a.json": "GeoJSON", "a.parquet": "GeoParquet", "a.txt": "ValueError", "a.own": "Own", "core": ["id", "geometry", "collection"], "validated": ["own rule"]}))
def registry(spark, d):
    """H7, H8: encodings and validators by suffix, and one of one's own."""
    from featurekit.plans.validate import Result
    from featurekit.registry import Encoding, Registry

    r = Registry()
    r.register(Encoding("Own", (".own",), geojson.read_geojson, geojson.write_geojson, lambda spark, path, **_: Result(errors=["own rule"], done=True)))
    name = lambda p: r.encoding(p).name if _fails(r.encoding, p) == "none" else _fails(r.encoding, p)
    return _said(spark, [*((p, name(p)) for p in ("a.json", "a.parquet", "a.txt", "a.own")), ("core", list(r.core_properties)), ("validated", r.encoding("a.own").validate(spark, "a.own").errors)])


@query(_values({"nations.json": 0, "gone.json": 1, "out": "[1, {\"at\": \"2024-01-02T00:00:00Z\"}]"}))
def command_line(spark, d):
    """K11, and the command line's codes."""
    from datetime import datetime

    from featurekit import cli

    path, out = _geojson_file(spark, d), str(_folder(spark) / "out.json")
    cli._emit([1, {"at": c.jsonable(datetime(2024, 1, 2))}], out, None)
    return _said(spark, [("nations.json", cli.run(["validate", path], spark)), ("gone.json", cli.run(["validate", path.replace("nations", "gone")], spark)), ("out", Path(out).read_text().strip())])
