"""GeoJSON source and sink (S3-S5, S7, K6-K10 of the inventory)."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable, Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType, StructType, TimestampNTZType, TimestampType, _parse_datatype_string

from featurekit.functions import crs as crs_
from featurekit.functions import geometry as g
from featurekit.functions.text import iso8601
from featurekit.operators.columns import ref
from featurekit.schema.collection import Collection, dehydrate
from featurekit.schema.collection import hydrate as fill
from featurekit.sources import splitjson
from featurekit.sources.geoparquet import filesystem
from featurekit.table import FeatureTable

#: Members of a Feature and a FeatureCollection that GeoJSON itself defines.
MEMBERS = {"type", "id", "bbox", "geometry", "properties", "features", "links"}


def _path(*keys: str) -> str:
    return "$" + "".join(f'["{k}"]' for k in keys)


def is_split(path: str) -> bool:
    """Whether a path names one file, which is scanned by ranges; folders and patterns of small files are not."""
    fs, root = filesystem(path)
    return fs.get_file_info(root).is_file


def _documents(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    """One VARIANT per document; with ``lines`` each line is one (newline-delimited features split across tasks)."""
    text = spark.read.text(path, wholetext=not lines)
    return text.filter(F.length(F.trim("value")) > 0).select(F.parse_json("value").alias("v"))


def _in_documents(docs: DataFrame) -> DataFrame:
    """Features (column f, VARIANT) of whole documents; other documents are an error when they are read."""
    kind = F.variant_get("v", "$.type", "string")
    several = F.variant_get("v", "$.features", "array<variant>")
    other = F.raise_error(F.lit("Only Feature and FeatureCollection are supported"))
    found = F.when(kind == "FeatureCollection", several).when(kind == "Feature", F.array("v")).otherwise(other)
    return docs.select(F.explode(found).alias("f"))


def scan(spark: SparkSession, path: str, num: int | None = None, lines: bool = False) -> tuple[Collection, DataFrame, str | None]:
    """Metadata, features (column f, VARIANT) in the file's order, and the document's type if it is one file. A file is scanned by ranges, side by side; the first
    ``num`` features by one task that reads no further. Newline-delimited files have no metadata."""
    some = num is not None and num >= 0
    if lines or not is_split(path):
        docs = _documents(spark, path, lines)
        features = _in_documents(docs)
        found = Collection() if lines else _members_of(docs)
        return found, features.limit(num) if some else features, None
    layout = (splitjson.head(path) if some else None) or splitjson.layout(spark, path)
    rows = splitjson.scan_first(spark, layout, num) if some else splitjson.scan(spark, layout)
    found = Collection({k: v for k, v in layout.members.items() if k not in MEMBERS})
    return found, rows.select(F.parse_json("value").alias("f")), layout.kind


def metadata(spark: SparkSession, path: str, lines: bool = False) -> Collection:
    """Top-level members that GeoJSON does not define; features are not decoded. Newline-delimited files have none."""
    if lines:
        return Collection()
    if not is_split(path):
        return _members_of(_documents(spark, path, lines))
    return Collection({k: v for k, v in splitjson.layout(spark, path).members.items() if k not in MEMBERS})


def _members_of(docs: DataFrame) -> Collection:
    spark, view = docs.sparkSession, f"geojson_{uuid.uuid4().hex}"
    docs.createOrReplaceTempView(view)
    skip = ", ".join(f"'{m}'" for m in sorted(MEMBERS))
    rows = spark.sql(f"SELECT key, to_json(value) AS value FROM {view}, LATERAL variant_explode(v) WHERE key NOT IN ({skip})").collect()
    spark.catalog.dropTempView(view)
    return Collection({r["key"]: json.loads(r["value"]) for r in rows})


def _sql_type(text: str) -> str:
    """A VARIANT's schema as a Spark type: decimals are doubles, unknown ones text."""
    text = re.sub(r"DECIMAL\(\d+,\d+\)", "DOUBLE", text).replace("VOID", "STRING").replace("VARIANT", "STRING")
    return re.sub(r"OBJECT<", "STRUCT<", text)


def property_types(features: DataFrame) -> dict[str, str]:
    """Names and types of all features' properties, from one aggregate."""
    row = features.select(F.schema_of_variant_agg(F.variant_get("f", "$.properties", "variant")).alias("s")).first()
    if not row or not row["s"] or not row["s"].startswith("OBJECT<"):
        return {}
    found = _parse_datatype_string(_quoted(_sql_type(row["s"])))
    return {f.name: f.dataType.simpleString() for f in found.fields} if isinstance(found, StructType) else {}


def _quoted(text: str) -> str:
    """The type with every field name in backticks."""
    return re.sub(r"([<,]\s*)([^<>,`()]+?):\s", lambda m: f"{m[1]}`{m[2].strip()}`: ", text)


def read_features(features: DataFrame, types: Mapping[str, str | DataType], wanted: Iterable[str] | None = None) -> DataFrame:
    """Typed rows of feature documents (column f, VARIANT). The id is the property's, else the feature's."""
    names = [n for n in types if wanted is None or n in wanted]
    has = lambda n: wanted is None or n in wanted
    simple = lambda n: types[n] if isinstance(types[n], str) else types[n].simpleString()
    cols: list[Column] = []
    if has("id"):
        own = F.variant_get("f", _path("properties", "id"), "string") if "id" in types else F.lit(None).cast("string")
        cols.append(F.coalesce(own, F.variant_get("f", "$.id", "string")).alias("id"))
    if has("geometry"):
        cols.append(g.from_geojson(F.variant_get("f", "$.geometry.type", "string"), F.to_json(F.variant_get("f", "$.geometry.coordinates", "variant"))).alias("geometry"))
    cols += [F.try_variant_get("f", _path("properties", n), simple(n)).alias(n) for n in names if n not in ("id", "geometry", "bbox")]
    return features.select(*cols)


def read_geojson(spark: SparkSession, path: str, num: int | None = None, properties: Iterable[str] | None = None, schema_map: Mapping[str, Any] | None = None, hydrate: bool = False, lines: bool = False) -> FeatureTable:
    """A Feature or FeatureCollection as a table; the first ``num`` rows (0 gives none) and named properties only, where
    given. Properties that a custom schema types have that type, the others the type that fits all their values in the
    rows that are read. With ``num`` only the file's first features and its last megabytes are read."""
    from featurekit.types import SCALARS

    collection, features, _ = scan(spark, path, num, lines)
    types: dict[str, str | DataType] = dict(property_types(features))
    known = collection.custom.get("properties", {})
    types = {n: SCALARS[known[n]["type"]][0] if n in known and known[n].get("type") in SCALARS else t for n, t in types.items()}
    df = read_features(features, types, set(properties) if properties else None)
    t = FeatureTable(df, collection, "EPSG:4326")
    return fill(t, schema_map) if hydrate else t


def read_flat(spark: SparkSession, path: str) -> DataFrame:
    """A FeatureCollection for converters: nested properties become columns named by their path."""
    from featurekit.functions.text import flatten_structs

    return flatten_structs(read_geojson(spark, path).df)


def _json_value(c: Column, kind: DataType) -> Column:
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return iso8601(c)
    return F.base64(c) if isinstance(kind, BinaryType) else c


def feature_json(df: DataFrame, top: Mapping[str, Any] | None = None, extra: Mapping[str, Any] | None = None, keep: Iterable[str] | None = None) -> Column:
    """Each row as a Feature document. Nulls are left out, a bbox struct becomes an array, times end in Z. ``top`` are
    further members, ``extra`` further properties."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    names = [n for n in df.columns if n not in ("id", "geometry", "bbox") and (keep is None or n in keep)]
    # The properties' object is made by to_json (which leaves nulls out) and joined to the geometry's text.
    props = F.struct(*(_json_value(ref(n), kinds[n]).alias(n) for n in names), *(F.lit(v).alias(k) if not isinstance(v, (dict, list)) else F.parse_json(F.lit(json.dumps(v))).alias(k) for k, v in (extra or {}).items() if keep is None or k in keep))
    props_json = F.to_json(props) if names or extra else F.lit("{}")
    shape = F.coalesce(g.to_geojson(F.col("geometry")), F.lit("null")) if "geometry" in kinds else F.lit("null")
    parts = [F.lit("{"), F.lit("".join(f"{json.dumps(k)}:{json.dumps(v)}," for k, v in (top or {}).items())), F.lit('"type":"Feature",')]
    if "id" in kinds:
        parts.append(F.coalesce(F.concat(F.lit('"id":'), _quote(ref("id").cast("string")), F.lit(",")), F.lit("")))
    if "bbox" in kinds:
        b = F.col("bbox")
        parts.append(F.coalesce(F.concat(F.lit('"bbox":'), F.to_json(F.array(b["xmin"], b["ymin"], b["xmax"], b["ymax"])), F.lit(",")), F.lit("")))
    return F.concat(*parts, F.lit('"geometry":'), shape, F.lit(',"properties":'), props_json, F.lit("}"))


def _quote(c: Column) -> Column:
    """A JSON string of a text, by way of an array of one."""
    one = F.to_json(F.array(c))
    return F.when(c.isNotNull(), F.substring(one, F.lit(2), F.length(one) - 2))


def features_of(df: DataFrame) -> DataFrame:
    """Rows as feature documents (column f, VARIANT), as a scan gives them."""
    return df.select(F.parse_json(feature_json(df)).alias("f"))


def _in_4326(t: FeatureTable) -> FeatureTable:
    if t.crs and crs_.code(t.crs) != 4326:
        return t.with_(df=t.df.withColumn(t.geometry, crs_.reproject(F.col(t.geometry), t.crs, 4326)), crs="EPSG:4326")
    return t


def _indented(rows: DataFrame, indent: int | None) -> DataFrame:
    """Column f, a JSON text behind a comma or not, with line breaks and ``indent`` blanks."""
    if not indent:
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("f")
            new = [json.dumps(json.loads(x), indent=indent, ensure_ascii=False) for x in b.column(at).to_pylist()]
            yield b.set_column(at, "f", pa.array(new, pa.string()))

    return rows.mapInArrow(run, rows.schema)


def _joined(spark: SparkSession, parts: str, path: str, head: str, tail: str) -> None:
    """One file of a head, all part files of a folder in the order of their names (without the first one's first byte, a
    comma), and a tail. The file system copies bytes; the file appears under its name when it is whole."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = lambda name: jvm.org.apache.hadoop.fs.Path(name)
    fs = at(path).getFileSystem(conf)
    if fs.getUri().getScheme() == "file":
        fs = fs.getRawFileSystem()  # without checksum files beside it
    whole = at(f"{parts}/_whole")
    out = fs.create(whole, True)
    try:
        out.write(head.encode())
        begun = False
        for name in sorted(f.getPath().toString() for f in fs.listStatus(at(parts)) if f.getLen() and f.getPath().getName().startswith("part-")):
            source = fs.open(at(name))
            if not begun:
                source.skip(1)
                begun = True
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, conf, False)
            source.close()
        out.write(tail.encode())
    finally:
        out.close()
    fs.delete(at(path), False)
    if at(path).getParent() is not None:
        fs.mkdirs(at(path).getParent())
    if not fs.rename(whole, at(path)):
        raise OSError(f"{path} cannot be written")


def _deleted(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def write_geojson(
    t: FeatureTable,
    path: str,
    properties: Iterable[str] | None = None,
    schema_map: Mapping[str, Any] | None = None,
    shrink: bool = True,
    indent: int | None = None,
) -> None:
    """One FeatureCollection file: constants as top-level members, coordinates in EPSG:4326. Tasks write parts beside it, in
    the order of the rows, which Spark commits once each; then they are joined, and no row comes to the driver."""
    t = _in_4326(dehydrate(t, list(properties) if properties else None, schema_map) if shrink else t)
    spark, parts = t.df.sparkSession, f"{path}.parts-{uuid.uuid4().hex}"
    members = "".join(f"{json.dumps(k)}:{json.dumps(v, allow_nan=False)}," for k, v in t.collection.items())
    rows = _indented(t.df.select(feature_json(t.df).alias("f")), indent)
    try:
        rows.select(F.concat(F.lit(","), "f").alias("value")).write.text(parts)
        _joined(spark, parts, path, "{" + members + '"type":"FeatureCollection","features":[\n', "]}\n")
    finally:
        _deleted(spark, parts)


def write_lines(t: FeatureTable, path: str) -> None:
    """Newline-delimited features, written by all tasks; for tables that one file should not hold."""
    t = _in_4326(t)
    t.df.select(feature_json(t.df)).write.text(path)


def _numbered(spark: SparkSession, rows: DataFrame, parts: str) -> DataFrame:
    """The rows with their running number, from 1: written first, so that what is counted is what is numbered."""
    rows.withColumn("_at", F.monotonically_increasing_id()).write.parquet(parts)
    kept = spark.read.schema(rows.withColumn("_at", F.lit(0).cast("bigint")).schema).parquet(parts)
    kept = kept.withColumn("_part", F.shiftright("_at", 33))
    before, offsets = 0, []
    for r in kept.groupBy("_part").count().orderBy("_part").collect():  # a row for each partition
        offsets.append((r["_part"], before))
        before += r["count"]
    known = F.broadcast(spark.createDataFrame(offsets, "_part bigint, _before bigint"))
    number = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    return kept.join(known, "_part").withColumn("number", number).drop("_at", "_part", "_before")


def write_features(
    t: FeatureTable,
    folder: str,
    num: int | None = None,
    properties: Iterable[str] | None = None,
    schema_map: Mapping[str, Any] | None = None,
    indent: int | None = None,
) -> list[str]:
    """One Feature file per row, named by its id (characters that file systems reserve are replaced; of equal names all but
    the first get a tilde and their number) or by a running number. Metadata that features may hold go into properties, the
    others to the top. Names are settled by counts; tasks write the files, a retried one the same files again."""
    t = _in_4326(t)
    spark = t.df.sparkSession
    here = t.collection.only_here(schema_map)
    top = {k: v for k, v in t.collection.items() if k in here}
    extra = {k: v for k, v in t.collection.items() if k not in here}
    df = t.df if num is None or num < 0 else t.df.limit(num)
    ids = ref("id").cast("string") if "id" in df.columns else F.lit(None).cast("string")
    rows = df.select(ids.alias("id"), feature_json(df, top, extra, set(properties) if properties else None).alias("f"))
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    parts = f"{folder.rstrip('/')}.parts-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = filesystem(folder)
        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with files.open_output_stream(f"{base}/{name}") as f:
                    f.write(text.encode())
            yield b.select(["name", "number"])

    try:
        numbered = _numbered(spark, rows, parts)
        stem = F.btrim(F.regexp_replace(F.coalesce("id", F.lit("")), r"[^\p{L}\p{N}_.\-]+", "_"), F.lit("."))
        numbered = numbered.withColumn("stem", F.coalesce(F.when(stem != "", stem), F.col("number").cast("string")))
        first = numbered.groupBy("stem").agg(F.min("number").alias("first"))
        name = F.when(F.col("number") == F.col("first"), F.col("stem")).otherwise(F.concat("stem", F.lit("~"), "number"))
        named = numbered.join(first, "stem").select(F.concat(name, F.lit(".json")).alias("name"), "f", "number")
        written = _indented(named, indent).mapInArrow(write, "name string, number bigint").orderBy("number").collect()
    finally:
        _deleted(spark, parts)
    return [f"{folder}/{r['name']}" for r in written]


def feature_rows(spark: SparkSession, documents: Iterable[Mapping[str, Any]]) -> DataFrame:
    """Feature documents given as mappings, as a scan gives them."""
    return spark.createDataFrame([Row(value=json.dumps(d)) for d in documents], "value string").select(F.parse_json("value").alias("f"))
