"""Validation of files (C11, C12, V20-V32 of the inventory): structure from metadata and footers, values by one aggregate."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featurekit.operators import rules
from featurekit.schema import jsonschema
from featurekit.schema.bundled import SPECIFICATION, version_matches
from featurekit.schema.collection import Collection, parse_schemas
from featurekit.sources import geojson, geoparquet
from featurekit.sources.discover import encoding_of
from featurekit.types import SCALARS, arrow_type


@dataclass
class Result:
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    infos: list[str] = field(default_factory=list)
    done: bool = False

    def is_valid(self) -> bool:
        if not self.done:
            raise RuntimeError("Validation has not run")
        return not self.errors

    @property
    def status(self) -> str:
        return "UNKNOWN" if not self.done else "VALID" if not self.errors else "INVALID"


def check_schemas(r: Result, collection: Collection, required: Sequence[str | re.Pattern] = (), mixed: bool = False) -> None:
    """Every collection needs a supported core schema, all of one version, and the required schemas."""
    versions = set()
    if not collection.schemas:
        r.errors.append("No schemas found")
    for cid, uris in collection.schemas.items():
        if not uris:
            r.errors.append(f"Collection '{cid}': No schemas found")
            continue
        version, _, _ = parse_schemas(uris)
        if version is None:
            r.errors.append(f"Collection '{cid}': No core schema found")
            continue
        versions.add(version)
        if not version_matches(version, SPECIFICATION):
            r.errors.append(f"Collection '{cid}': Version {version} is not supported")
        for want in required:
            if not any(want.fullmatch(u) if isinstance(want, re.Pattern) else u == want for u in uris):
                r.errors.append(f"Collection '{cid}': Required schema {want.pattern if isinstance(want, re.Pattern) else want} not found")
    if len(versions) > 1:
        (r.warnings if mixed else r.errors).append("Multiple versions of the specification in one file")


def _geo_problems(geo: Any) -> Iterable[str]:
    """What a geo footer lacks."""
    if not isinstance(geo, Mapping):
        yield "No valid geo metadata found"
        return
    if geo.get("version") not in geoparquet.VERSIONS:
        yield f"geo: unsupported version {geo.get('version')}"
    columns = geo.get("columns")
    if not isinstance(columns, Mapping) or geo.get("primary_column") not in columns:
        yield "geo: the primary column is not described"
        return
    for name, c in columns.items():
        if c.get("encoding") != "WKB":
            yield f"geo: column {name}: unsupported encoding {c.get('encoding')}"
        if not isinstance(c.get("geometry_types"), list):
            yield f"geo: column {name}: geometry_types is missing"


def _type_problem(kind: pa.DataType, prop: Mapping[str, Any]) -> str | None:
    want = prop.get("type")
    string = pa.types.is_string(kind) or pa.types.is_large_string(kind)
    ok = {
        "string": string,
        "geometry": pa.types.is_binary(kind) or pa.types.is_large_binary(kind),
        "binary": pa.types.is_binary(kind) or pa.types.is_large_binary(kind),
        "date-time": pa.types.is_timestamp(kind),
        "date": pa.types.is_date(kind),
        "array": pa.types.is_list(kind) or pa.types.is_large_list(kind),
        "object": pa.types.is_struct(kind) or pa.types.is_map(kind),
        "bounding-box": pa.types.is_struct(kind) and {f.name for f in kind} >= {"xmin", "ymin", "xmax", "ymax"},
    }
    if want in ok:
        return None if ok[want] else f"is {kind}, but must be {want}"
    return None if want not in SCALARS or kind == arrow_type(prop) else f"is {kind}, but must be {want}"


def _structure(r: Result, f: geoparquet.Footer, schema: Mapping[str, Any], here: set[str], single: bool) -> None:
    names = {x.name for x in f.schema}
    props = schema["properties"]
    for name in sorted(set(schema["required"]) - names - here):
        r.errors.append(f"{name}: Required column is missing")
    for x in f.schema:
        prop = props.get(x.name)
        if prop is None:
            if x.name != "bbox":
                r.warnings.append(f"{x.name}: No schema defined")
            continue
        if "type" not in prop:
            r.warnings.append(f"{x.name}: No type specified")
            continue
        if single and x.nullable != (x.name not in schema["required"]):
            r.errors.append(f"{x.name}: Nullability is {x.nullable}, but must be {not x.nullable}")
        if found := _type_problem(x.type, prop):
            r.errors.append(f"{x.name}: Type {found}")
        elif prop["type"] == "date-time":
            if x.type.unit != "ms":
                r.warnings.append(f"{x.name}: Timestamp unit should be milliseconds")
            if x.type.tz != "UTC":
                r.errors.append(f"{x.name}: Timezone must be UTC")
        elif prop["type"] == "object" and pa.types.is_map(x.type) and not pa.types.is_string(x.type.key_type):
            r.errors.append(f"{x.name}: Map keys must be strings")
        elif prop["type"] == "geometry":
            column = (f.geo or {}).get("columns", {}).get(x.name)
            if column is None:
                r.errors.append(f"{x.name}: Geometry column is not described in the geo metadata")
            elif prop.get("geometryTypes") and sorted(column.get("geometry_types", [])) != sorted(prop["geometryTypes"]):
                r.warnings.append(f"{x.name}: Geometry types are {sorted(column.get('geometry_types', []))}, expected {sorted(prop['geometryTypes'])}")


def data_issues(df: DataFrame, schemas: Mapping[str, Mapping[str, Any]]) -> list[str]:
    """Messages of each collection's first offending values: its rows, its rules, in one pass over all of them. Columns
    without rules are skipped."""
    several = len(schemas) > 1 and "collection" in df.columns
    wanted = {cid if several else None: schema["properties"] for cid, schema in schemas.items()}
    numbered = df.withColumn("__row", F.monotonically_increasing_id())
    return rules.first_issues(numbered, wanted, F.col("__row"))


def validate_parquet(spark: SparkSession, path: str, num: int = 100, schema_map: Mapping[str, Any] | None = None, required: Sequence[str | re.Pattern] = ()) -> Result:
    """A GeoParquet file: footer, schemas, structure, then values of the first ``num`` rows (-1: all)."""
    r = Result()
    try:
        f = geoparquet.footer(path, spark)
    except (OSError, pa.ArrowInvalid) as e:
        r.errors.append(str(e))
        r.done = True
        return r
    r.done = True
    r.errors += _geo_problems(f.geo)
    if not r.errors and not f.collection:
        r.errors.append("No collection metadata found")
    if r.errors:
        return r
    check_schemas(r, f.collection, required)
    schemas = {cid: f.collection.merged_schema(schema_map, cid) for cid in f.collection.schemas}
    whole = f.collection.merged_schema(schema_map)
    _structure(r, f, whole, f.collection.only_here(schema_map) | set(f.collection), len(schemas) <= 1)
    t = geoparquet.read_geoparquet(spark, path, num if num >= 0 else None, schema_map=schema_map, hydrate=True)
    r.errors += data_issues(t.df, schemas or {"": whole})
    if 0 <= num < f.rows:
        r.warnings.append(f"Only the first {num} of {f.rows} rows were validated")
    return r


def validate_geojson(spark: SparkSession, path: str, num: int = 100, schema_map: Mapping[str, Any] | None = None, required: Sequence[str | re.Pattern] = (), most: int = 1000) -> Result:
    """A Feature or FeatureCollection: metadata, schemas, then each feature against its collection's JSON Schema, in
    parallel over features (-1: all of them). A warning says so if features have more than ``most`` errors; those beyond
    are not listed."""
    r = Result()
    try:
        collection, features, kind = geojson.scan(spark, path, num)
    except Exception as e:  # a file that can't be read is a result, not a failure of the validator
        r.errors.append(str(e))
        r.done = True
        return r
    r.done = True
    if not collection:
        r.errors.append("No collection metadata found")
        return r
    check_schemas(r, collection, required, mixed=True)
    documents = {cid: jsonschema.document(_without_context(collection.merged_schema(schema_map, cid))) for cid in collection.schemas}
    single = kind == "Feature"
    shared = {k: v for k, v in collection.items() if k not in collection.only_here(schema_map)}
    top = {k: v for k, v in collection.items() if k in collection.only_here(schema_map)}

    def check(batches):
        for b in batches:
            out = []
            for text in b.column(0).to_pylist():
                out += _feature_errors(json.loads(text), documents, shared, top)
            yield pa.RecordBatch.from_pydict({"at": pa.array(range(len(out)), pa.int64()), "message": pa.array(out, pa.string())})

    found = features.select(F.to_json("f").alias("f")).mapInArrow(check, "at bigint, message string")
    rows = found.limit(most + 1).collect()  # a report, not the data
    if len(rows) > most:
        r.warnings.append(f"Only the first {most} errors of features are listed")
    for i, row in enumerate(rows[:most]):
        message = row["message"]
        r.errors.append(message if single or not message.startswith("\x00") else f"Feature {i}: {message[1:]}")
    return r


def _without_context(schema: Mapping[str, Any]) -> dict[str, Any]:
    """The schema for features checked one by one; what only metadata may have is checked there."""
    above = {k for k, v in schema["collection"].items() if v} | {"schemas", "schemas:custom"}
    return {"required": [x for x in schema["required"] if x not in above], "collection": {}, "properties": {k: v for k, v in schema["properties"].items() if k not in above}}


def _feature_errors(feature: dict, documents: Mapping[str, Any], shared: Mapping[str, Any], top: Mapping[str, Any]) -> list[str]:
    props = dict(shared) | (feature.get("properties") or {})
    cid = props.get("collection") or (next(iter(documents)) if len(documents) == 1 else None)
    if cid is None:
        return ["\x00Missing the 'collection' property"]
    if cid not in documents:
        return [f"Collection '{cid}' not found in schemas"]
    members = {k: v for k, v in feature.items() if k not in top and k not in shared}
    return [m for _, m in jsonschema.validate(members | {"properties": props | {"collection": cid}}, documents[cid])]


def validate(spark: SparkSession, path: str, num: int = 100, schema_map: Mapping[str, Any] | None = None, required: Sequence[str | re.Pattern] = ()) -> Result:
    fn = validate_parquet if encoding_of(path) == "geoparquet" else validate_geojson
    return fn(spark, path, num, schema_map, required)


def validate_files(spark: SparkSession, paths: Iterable[str], **options: Any) -> dict[str, Result]:
    return {p: validate(spark, p, **options) for p in paths}


