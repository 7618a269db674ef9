"""Queries over the generated tables, one per operator or group of operators, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featurekit.functions import crs, text
from featurekit.functions import geometry as g
from featurekit.operators import columns as c
from featurekit.operators import rules
from featurekit.operators.union import union

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def _round(column: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, digits)


@query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer")
def rename_project(spark, d):
    return c.map_columns(table(spark, d, "customer"), {"c_custkey": "id", "c_name": "name", "c_mktsegment": "segment"})


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT coalesce(o_orderstatus IN ('F'), false)")
def row_filter_inverted(spark, d):
    return c.filter_rows(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), {"o_orderstatus": lambda s: (s.isin("F"), True)})


@query("""SELECT n_nationkey AS id, n_name AS name, 'DE' AS "admin:country_code", 'nations' AS collection FROM nation UNION ALL
SELECT s_suppkey, s_name, 'DE', 'suppliers' FROM supplier""")
def constant_columns(spark, d):
    nation = c.add_constants(c.map_columns(table(spark, d, "nation"), {"n_nationkey": "id", "n_name": "name"}), c.admin_columns("de_all"), "nations")
    supplier = c.add_constants(c.map_columns(table(spark, d, "supplier"), {"s_suppkey": "id", "s_name": "name"}), c.admin_columns("de_all"), "suppliers")
    return union([nation, supplier])


@query("SELECT p_partkey AS id, round(p_size * 0.0001, 8) AS area FROM part")
def column_migration(spark, d):
    df = c.migrate_columns(table(spark, d, "part"), {"p_size": lambda s: F.round(s * 0.0001, 8)})
    return c.map_columns(df, {"p_partkey": "id", "p_size": "area"})


@query("SELECT s_suppkey AS id, s_suppkey AS code, s_name AS name FROM supplier")
def column_duplication(spark, d):
    return c.map_columns(table(spark, d, "supplier"), {"s_suppkey": ["id", "code"], "s_name": "name"})


def _merged(spark, d):
    customer = c.map_columns(table(spark, d, "customer"), {"c_custkey": "id", "c_acctbal": "balance", "c_mktsegment": "segment"}).withColumns({"collection": F.lit("customers"), "unused": F.lit(None).cast("string")})
    supplier = c.map_columns(table(spark, d, "supplier"), {"s_suppkey": "id", "s_acctbal": "balance", "s_name": "name"}).withColumns({"collection": F.lit("suppliers"), "unused": F.lit(None).cast("string")})
    return union([customer, supplier])


@query("SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment, 'customers' AS collection, NULL::VARCHAR AS name FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL, 'suppliers', s_name FROM supplier")
def merge_union(spark, d):
    return c.drop_null_columns(_merged(spark, d))


@query("SELECT r_regionkey AS id, r_name AS title, 'CC-BY-4.0' AS license FROM region")
def hydrate(spark, d):
    from featurekit.schema.collection import Collection
    from featurekit.schema.collection import hydrate as fill
    from featurekit.table import FeatureTable

    df = c.map_columns(table(spark, d, "region"), {"r_regionkey": "id", "r_name": "title"})
    return fill(FeatureTable(df, Collection({"title": "constant", "license": "CC-BY-4.0"}))).df


_PROFILED = ["l_linenumber", "l_returnflag", "l_linestatus", "unit", "note"]


@query(" UNION ALL ".join(f"SELECT '{n}' AS column_name, count({e}) AS n_values, count(DISTINCT {e}) + max(CASE WHEN {e} IS NULL THEN 1 ELSE 0 END) = 1 AS is_constant FROM lineitem" for n, e in zip(_PROFILED, ["l_linenumber", "l_returnflag", "l_linestatus", "'kg'", "CAST(NULL AS VARCHAR)"], strict=True)))
def dehydrate_profile(spark, d):
    """A1, A2: counts and bounds of all columns from one aggregate, and which have one value."""
    df = table(spark, d, "lineitem").select("l_linenumber", "l_returnflag", "l_linestatus").withColumns({"unit": F.lit("kg"), "note": F.lit(None).cast("string")})
    of = lambda n, what: c.ref(f"{n}\x00{what}")
    constant = lambda n: (of(n, "n") == 0) | ((of(n, "n") == F.col("n")) & (of(n, "lo") == of(n, "hi")))
    rows = F.array(*(F.struct(F.lit(n).alias("column_name"), of(n, "n").alias("n_values"), F.coalesce(constant(n), F.lit(False)).alias("is_constant")) for n in _PROFILED))
    return c.constant_profile(df, _PROFILED).select(F.explode(rows).alias("x")).select("x.*")


@query(" UNION ALL ".join(f"SELECT '{n}' AS column_name FROM (SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment, 'customers' AS collection, NULL::VARCHAR AS name, NULL::VARCHAR AS unused FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL, 'suppliers', s_name, NULL FROM supplier) HAVING count({n}) > 0" for n in ("id", "balance", "segment", "collection", "name", "unused")))
def null_column_profile(spark, d):
    """P10, A3: the columns that are left when those without any value go."""
    return spark.createDataFrame([(n,) for n in c.drop_null_columns(_merged(spark, d)).columns], "column_name string")


def _violations(name: str, expressions: dict[str, str], source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{col}' AS column_name, '{rule}' AS rule, count(*) FILTER (WHERE {sql}) AS violations FROM {source}" for (col, rule), sql in expressions.items())


_STRINGS = {"c_mktsegment": {"type": "string", "minLength": 6, "maxLength": 9, "pattern": "^[A-M]", "enum": ["BUILDING", "MACHINERY"]}, "c_name": {"type": "string", "maxLength": 17, "pattern": "Customer#.*[02468]$"}}


@query(_violations("customer", {
    ("c_mktsegment", "minLength"): "length(c_mktsegment) < 6",
    ("c_mktsegment", "maxLength"): "length(c_mktsegment) > 9",
    ("c_mktsegment", "pattern"): "NOT regexp_matches(c_mktsegment, '^(?:^[A-M])')",
    ("c_mktsegment", "enum"): "c_mktsegment NOT IN ('BUILDING', 'MACHINERY')",
    ("c_name", "maxLength"): "length(c_name) > 17",
    ("c_name", "pattern"): "NOT regexp_matches(c_name, '^(?:Customer#.*[02468]$)')",
}, "customer"))
def validate_strings(spark, d):
    return rules.count_violations(table(spark, d, "customer"), _STRINGS)


_NUMBERS = {"l_quantity": {"type": "double", "minimum": 2, "maximum": 49}, "l_discount": {"type": "double", "exclusiveMinimum": 0, "exclusiveMaximum": 0.1}, "l_linenumber": {"type": "int32", "enum": [1, 2, 3]}}


@query(_violations("lineitem", {
    ("l_quantity", "minimum"): "l_quantity < 2",
    ("l_quantity", "maximum"): "l_quantity > 49",
    ("l_discount", "exclusiveMinimum"): "l_discount <= 0",
    ("l_discount", "exclusiveMaximum"): "l_discount >= 0.1",
    ("l_linenumber", "enum"): "l_linenumber NOT IN (1, 2, 3)",
}, "lineitem"))
def validate_numbers(spark, d):
    return rules.count_violations(table(spark, d, "lineitem"), _NUMBERS)


_FORMATS = {"url": {"type": "string", "format": "uri"}, "mail": {"type": "string", "format": "email"}, "uid": {"type": "string", "format": "uuid"}}


@query("SELECT 'url' AS column_name, 'format' AS rule, count(*) FILTER (WHERE NOT regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*:')) AS violations FROM pages UNION ALL SELECT 'mail', 'format', count(*) FILTER (WHERE page_id % 3 = 0) FROM pages UNION ALL SELECT 'uid', 'format', count(*) FILTER (WHERE page_id % 2 = 0) FROM pages")
def validate_formats(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    mail = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("a@b"), F.col("page_id"))).otherwise(F.concat(F.lit("a@b"), F.col("page_id"), F.lit(".org")))
    uid = F.when(F.col("page_id") % 2 == 0, "x").otherwise(F.concat(F.lit("00000000-0000-1000-8000-"), F.lpad(F.col("page_id").cast("string"), 12, "0")))
    return rules.count_violations(pages.withColumns({"mail": mail, "uid": uid}), _FORMATS)


_ARRAYS = {"embedding": {"type": "array", "minItems": 64, "maxItems": 63, "uniqueItems": True, "items": {"type": "float"}}}


@query("SELECT 'embedding' AS column_name, 'minItems' AS rule, count(*) FILTER (WHERE len(embedding) < 64) AS violations FROM embeddings UNION ALL SELECT 'embedding', 'maxItems', count(*) FILTER (WHERE len(embedding) > 63) FROM embeddings UNION ALL SELECT 'embedding', 'uniqueItems', count(*) FILTER (WHERE len(list_distinct(embedding)) <> len(embedding)) FROM embeddings")
def validate_arrays(spark, d):
    return rules.count_violations(table(spark, d, "embeddings").select("embedding"), _ARRAYS)


@query("SELECT 'bbox' AS column_name, 'x' AS rule, count(*) FILTER (WHERE l_quantity > 30) AS violations FROM lineitem UNION ALL SELECT 'bbox', 'y', count(*) FILTER (WHERE NOT l_quantity > 30 AND l_discount > 0.05) FROM lineitem")
def validate_bbox(spark, d):
    box = F.struct(F.col("l_quantity").alias("xmin"), F.col("l_discount").alias("ymin"), F.lit(30.0).alias("xmax"), F.lit(0.05).alias("ymax"))
    return rules.count_violations(table(spark, d, "lineitem").select(box.alias("bbox")), {"bbox": {"type": "bounding-box"}})


_PER_COLLECTION = {"1-URGENT": {"o_totalprice": {"type": "double", "minimum": 100000}}, "5-LOW": {"o_totalprice": {"type": "double", "maximum": 200000}}}


@query("SELECT '1-URGENT' AS collection, 'o_totalprice' AS column_name, 'minimum' AS rule, count(*) FILTER (WHERE o_totalprice < 100000) AS violations FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT '5-LOW', 'o_totalprice', 'maximum', count(*) FILTER (WHERE o_totalprice > 200000) FROM orders WHERE o_orderpriority = '5-LOW'")
def validate_per_collection(spark, d):
    df = table(spark, d, "orders").select("o_totalprice", F.col("o_orderpriority").alias("collection"))
    return rules.count_by_collection(df, _PER_COLLECTION)


_FIRST = "SELECT '{0}' AS column_name, '{1}' AS rule, count(*) FILTER (WHERE {2}) AS violations, CAST(arg_min({0}, row(l_orderkey, l_linenumber)) FILTER (WHERE {2}) AS VARCHAR) AS first_value FROM lineitem"


@query(" UNION ALL ".join(_FIRST.format(*x) for x in [("l_linenumber", "maximum", "l_linenumber > 5"), ("l_returnflag", "enum", "l_returnflag NOT IN ('A', 'N')")]))
def first_violation(spark, d):
    wanted = {"l_linenumber": {"type": "int32", "maximum": 5}, "l_returnflag": {"type": "string", "enum": ["A", "N"]}}
    return rules.first_violations(table(spark, d, "lineitem"), wanted, F.struct("l_orderkey", "l_linenumber")).drop("message")


@query("SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS \"props.k\" FROM events")
def flatten_json(spark, d):
    df = table(spark, d, "events").select("event_id", "event_type", F.from_json("props", "k bigint").alias("props"))
    return text.flatten_structs(df)


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN rtrim(strftime(ts, '%f'), '0') = '' THEN '' ELSE '.' || rtrim(strftime(ts, '%f'), '0') END || 'Z' AS ts FROM events")
def iso_timestamps(spark, d):
    return table(spark, d, "events").select("event_id", text.iso8601(F.col("ts")).alias("ts"))


@query("SELECT strftime(min(o_orderdate), '%Y-%m-%dT%H:%M:%SZ') AS start, strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%SZ') AS \"end\" FROM orders")
def temporal_extent(spark, d):
    from featurekit.stac import temporal_extent as extent

    return extent(table(spark, d, "orders"), "o_orderdate")


def _points(spark, d) -> DataFrame:
    e = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", g.point(e[0].cast("double") * 180, e[1].cast("double") * 80).alias("geometry"))


_LON, _LAT = "CAST(embedding[1] AS DOUBLE) * 180", "CAST(embedding[2] AS DOUBLE) * 80"


@query(f"SELECT round(min({_LON}), 6) AS xmin, round(min({_LAT}), 6) AS ymin, round(max({_LON}), 6) AS xmax, round(max({_LAT}), 6) AS ymax FROM embeddings")
def spatial_extent(spark, d):
    return g.total_bounds(_points(spark, d)).select(*(_round(x).alias(x) for x in ("xmin", "ymin", "xmax", "ymax")))


def _boxes(spark, d) -> DataFrame:
    zero = F.lit(0.0)
    return table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice", g.rectangle(zero, zero, F.col("p_size"), F.col("p_retailprice") / 100).alias("geometry"))


@query("SELECT p_partkey, round(CASE WHEN p_partkey % 2 = 0 THEN 1.0 ELSE p_size * p_retailprice / 100 END, 6) AS \"metrics:area\", round(2 * (p_size + p_retailprice / 100), 6) AS \"metrics:perimeter\" FROM part")
def polygon_metrics(spark, d):
    from featurekit.operators.improve import add_sizes

    df = _boxes(spark, d).withColumn("metrics:area", F.when(F.col("p_partkey") % 2 == 0, 1.0))
    return add_sizes(df, "EPSG:3857").select("p_partkey", _round("metrics:area").alias("metrics:area"), _round("metrics:perimeter").alias("metrics:perimeter"))


@query("SELECT p_partkey, least(0.0, p_size, p_size / 2.0) AS xmin, 0.0 AS ymin, greatest(p_size, p_size / 2.0) AS xmax, round(p_retailprice, 6) AS ymax FROM part")
def row_bbox(spark, d):
    size, zero = F.col("p_size"), F.lit(0.0)
    shape = g.polygon(g.ring((zero, zero), (size, zero), (size / 2, F.col("p_retailprice")), (zero, zero)))
    b = g.bounds(shape)
    return table(spark, d, "part").select("p_partkey", *(_round(b[x]).alias(x) for x in ("xmin", "ymin", "xmax", "ymax")))


@query("SELECT l_orderkey AS id, 'Polygon' AS type, CAST(l_linenumber AS DOUBLE) AS xmin, l_quantity AS ymin FROM lineitem")
def explode_parts(spark, d):
    n, q = F.col("l_linenumber").cast("double"), F.col("l_quantity")
    square = F.array(g.ring((n, q), (n + 1, q), (n + 1, q + 1), (n, q + 1), (n, q)))
    multi = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(square).alias("parts"))  # an order has a few lines
    df = g.explode_parts(multi.select("id", g.geometry("MultiPolygon", F.col("parts")).alias("geometry")))
    b = g.bounds(F.col("geometry"))
    return df.select("id", g.geometry_type(F.col("geometry")).alias("type"), b["xmin"].alias("xmin"), b["ymin"].alias("ymin"))


@query(f"SELECT vec_id, round(radians({_LON}) * 6378137, 3) AS x, round(ln(tan(pi() / 4 + radians({_LAT}) / 2)) * 6378137, 3) + 0 AS y FROM embeddings")
def reproject_web_mercator(spark, d):
    moved = crs.reproject(F.col("geometry"), 4326, 3857)
    p = _points(spark, d).select("vec_id", moved["parts"][0][0][0].alias("p"))
    return p.select("vec_id", F.round(F.col("p")[0], 3).alias("x"), (F.round(F.col("p")[1], 3) + 0.0).alias("y"))


_S6933 = "sin(radians({0}))"
_Q6933 = f"((1 - {crs.E2!r}) * ({_S6933} / (1 - {crs.E2!r} * {_S6933} * {_S6933}) - ln((1 - {crs.E!r} * {_S6933}) / (1 + {crs.E!r} * {_S6933})) / (2 * {crs.E!r})))"


@query(f"SELECT p_partkey, round(radians(p_size / 50.0) * {crs.A * crs.K6933!r} * {crs.A / (2 * crs.K6933)!r} * {_Q6933.format('p_retailprice / 100')} / 1e6, 4) AS km2 FROM part")
def equal_area(spark, d):
    zero = F.lit(0.0)
    box = g.rectangle(zero, zero, F.col("p_size") / 50, F.col("p_retailprice") / 100)
    df = table(spark, d, "part").select("p_partkey", crs.reproject(box, 4326, 6933).alias("geometry"))
    return df.select("p_partkey", F.round(g.area(F.col("geometry")) / 1e6, 4).alias("km2"))


@query("SELECT p_partkey FROM part WHERE p_partkey % 3 <> 0")
def polygon_valid_filter(spark, d):
    from featurekit.operators.improve import keep_valid_polygons

    s, zero = F.col("p_size").cast("double"), F.lit(0.0)
    good, bow = g.rectangle(zero, zero, s, s), g.polygon(g.ring((zero, zero), (s, s), (s, zero), (zero, s), (zero, zero)))
    df = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, bow).otherwise(good).alias("geometry"))
    return keep_valid_polygons(df).select("p_partkey")


@query(f"SELECT vec_id, 'Point' AS type, round({_LON}, 9) AS x, round({_LAT}, 9) AS y FROM embeddings")
def wkb_roundtrip(spark, d):
    from featurekit.functions.wkb import from_wkb, to_wkb

    df = _points(spark, d).withColumn("wkb", to_wkb(F.col("geometry"))).select("vec_id", from_wkb(F.col("wkb")).alias("geometry"))
    p = F.col("geometry")["parts"][0][0][0]
    return df.select("vec_id", F.col("geometry.type").alias("type"), F.round(p[0], 9).alias("x"), F.round(p[1], 9).alias("y"))


@query()
def hilbert_order(spark, d):
    df = _points(spark, d)
    return df.select("vec_id", g.hilbert_key(F.col("geometry"), (-180.0, -90.0, 180.0, 90.0)).alias("key"))


def _nations(spark, d) -> DataFrame:
    key = F.col("n_nationkey").cast("double")
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.lit("nations").alias("collection"), F.col("n_name").alias("name"), g.point(key * 4 - 50, key * 2).alias("geometry"))


_ROUNDTRIP = "SELECT CAST(n_nationkey AS VARCHAR) AS id, 'nations' AS collection, n_name AS name, n_nationkey * 4.0 - 50 AS x, n_nationkey * 2.0 AS y FROM nation"


def _flat(df: DataFrame) -> DataFrame:
    p = F.col("geometry")["parts"][0][0][0]
    return df.select("id", "collection", "name", p[0].alias("x"), p[1].alias("y"))


@query(_ROUNDTRIP.replace("n_nationkey * 4.0 - 50", "CAST(n_nationkey * 4.0 - 50 AS DOUBLE)").replace("n_nationkey * 2.0", "CAST(n_nationkey * 2.0 AS DOUBLE)"))
def geojson_roundtrip(spark, d):
    from featurekit.sources.geojson import features_of, read_features

    features = features_of(_nations(spark, d))
    return _flat(read_features(features, {"collection": "string", "name": "string"}))


@query(ORACLE["geojson_roundtrip"])
def geoparquet_roundtrip(spark, d):
    from featurekit.sources.geoparquet import read_geoparquet, scratch_path, write_geoparquet
    from featurekit.table import FeatureTable

    path = scratch_path(spark)
    write_geoparquet(FeatureTable(_nations(spark, d)), path)
    return _flat(read_geoparquet(spark, path).df)


@query("SELECT s_suppkey, s_name AS name, 'https://example.org/' || s_suppkey AS url FROM supplier")
def link_parse(spark, d):
    link = F.concat("s_name", F.lit(" <https://example.org/"), "s_suppkey", F.lit(">"))
    return table(spark, d, "supplier").select("s_suppkey", text.link_name(link).alias("name"), text.link_url(link).alias("url"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10")
def head_limit(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(10)


_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in _TABLES))
def feature_count(spark, d):
    return reduce(DataFrame.unionByName, [table(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n") for t in _TABLES])


def entry(spark: SparkSession, d: str) -> DataFrame:
    """Rectangles with box, area and perimeter, united with points, and how many rows of each collection break a rule."""
    from featurekit.operators.improve import add_sizes

    boxes = add_sizes(_boxes(spark, d).select(F.col("p_partkey").cast("string").alias("id"), F.lit("parts").alias("collection"), "geometry"), "EPSG:3857")
    both = union([boxes, _nations(spark, d).drop("name")])
    return rules.count_by_collection(both, {"parts": {"metrics:area": {"type": "double", "maximum": 400}, "id": {"type": "string", "maxLength": 2}}, "nations": {"id": {"type": "string", "minLength": 2}}})


