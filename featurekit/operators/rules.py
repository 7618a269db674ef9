"""Per-value rules compiled to Catalyst predicates (V of the inventory), and the aggregates that report them in one pass."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, MapType, StructType

from featurekit.functions.geometry import geometry_type
from featurekit.operators.columns import ref

#: Patterns of formats. Fixed values.
FORMATS = {
    "email": (r"^[^@]+@[^@]+\.[^@]+$", "String '{v}' is not a valid email address."),
    "uri": (r"^[A-Za-z][A-Za-z0-9+.\-]*:", "String '{v}' is not a valid URI."),
    "uuid": (r"^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$", "String '{v}' is not a valid UUID."),
}
NUMERIC = {"int8", "uint8", "int16", "uint16", "int32", "uint32", "int64", "uint64", "float", "double"}
SCALAR = NUMERIC | {"string", "boolean", "date", "date-time"}


@dataclass(frozen=True)
class Check:
    """A rule of a column: what breaks it, and how that is said ({v} is the value)."""

    column: str
    rule: str
    bad: Column
    message: str


def _names(values: list[Any]) -> str:
    return ", ".join(map(str, values))


def _of_string(c: Column, r: Mapping[str, Any]):
    if "minLength" in r:
        yield "minLength", F.length(c) < r["minLength"], f"String '{{v}}' is shorter than the minimum length of {r['minLength']}."
    if "maxLength" in r:
        yield "maxLength", F.length(c) > r["maxLength"], f"String '{{v}}' is longer than the maximum length of {r['maxLength']}."
    if "pattern" in r:
        yield "pattern", ~c.rlike(f"^(?:{r['pattern']})"), f"String '{{v}}' does not match the required pattern: {r['pattern']}."
    if "enum" in r:
        yield "enum", ~c.isin(list(r["enum"])), f"String '{{v}}' is not one of the allowed values in the enumeration: {_names(r['enum'])}"
    if r.get("format") in FORMATS:
        pattern, message = FORMATS[r["format"]]
        yield "format", ~c.rlike(pattern), message


def _of_number(c: Column, r: Mapping[str, Any]):
    if "minimum" in r:
        yield "minimum", c < r["minimum"], f"Value {{v}} is less than the minimum allowed value of {r['minimum']}."
    if "maximum" in r:
        yield "maximum", c > r["maximum"], f"Value {{v}} is greater than the maximum allowed value of {r['maximum']}."
    if "exclusiveMinimum" in r:
        yield "exclusiveMinimum", c <= r["exclusiveMinimum"], f"Value {{v}} is less than or equal to the exclusive minimum value of {r['exclusiveMinimum']}."
    if "exclusiveMaximum" in r:
        yield "exclusiveMaximum", c >= r["exclusiveMaximum"], f"Value {{v}} is greater than or equal to the exclusive maximum value of {r['exclusiveMaximum']}."
    if "enum" in r:
        yield "enum", ~c.isin(list(r["enum"])), f"Integer '{{v}}' is not one of the allowed values in the enumeration: {_names(r['enum'])}"


def _of_array(c: Column, r: Mapping[str, Any]):
    if "minItems" in r:
        yield "minItems", F.size(c) < r["minItems"], f"Array has fewer items than the minimum of {r['minItems']}."
    if "maxItems" in r:
        yield "maxItems", F.size(c) > r["maxItems"], f"Array has more items than the maximum of {r['maxItems']}."
    if r.get("uniqueItems") and r.get("items", {}).get("type", "string") in SCALAR:
        yield "uniqueItems", F.size(F.array_distinct(c)) != F.size(c), "Array items are not unique."


def _of_object(c: Column, r: Mapping[str, Any], kind: DataType | None):
    struct = isinstance(kind, StructType)
    size = reduce(Column.__add__, [c[n].isNotNull().cast("int") for n in kind.fieldNames()], F.lit(0)) if struct else F.size(F.map_keys(c))
    if "minProperties" in r:
        yield "minProperties", size < r["minProperties"], f"Object has fewer properties than the minimum of {r['minProperties']}."
    if "maxProperties" in r:
        yield "maxProperties", size > r["maxProperties"], f"Object has more properties than the maximum of {r['maxProperties']}."
    for key in r.get("properties", {}):
        missing = F.lit(key not in kind.fieldNames()) if struct else ~F.map_contains_key(c, key)
        yield f"key:{key}", missing, f"Key '{key}' is missing from the object."


def _of_bbox(c: Column):
    x = c["xmin"] > c["xmax"]
    yield "x", x, "Bounding box has xmin value greater than xmax value: {v}"
    yield "y", ~x & (c["ymin"] > c["ymax"]), "Bounding box has ymin value greater than ymax value: {v}"


def _of_geometry(c: Column, r: Mapping[str, Any]):
    from featurekit.functions.validity import invalid_reason

    if r.get("geometryTypes"):
        yield "geometryTypes", ~geometry_type(c).isin(list(r["geometryTypes"])), f"Geometry type '{{v}}' is not one of the allowed types: {_names(r['geometryTypes'])}"
    if r.get("validity", True):
        yield "validity", invalid_reason(c).isNotNull(), "Geometry {v} is not valid"


def compile_checks(name: str, rules: Mapping[str, Any], kind: DataType | None = None) -> list[Check]:
    """Checks of one column; a null value breaks none. Types without rules of their own get none."""
    c, t = ref(name), rules.get("type")
    if t == "string":
        found = _of_string(c, rules)
    elif t in NUMERIC:
        found = _of_number(c, rules)
    elif t == "array":
        found = _of_array(c, rules)
    elif t == "object" and isinstance(kind, (StructType, MapType)):
        found = _of_object(c, rules, kind)
    elif t == "bounding-box":
        found = _of_bbox(c)
    elif t == "geometry":
        found = _of_geometry(c, rules)
    else:
        found = ()
    return [Check(name, rule, F.coalesce(c.isNotNull() & bad, F.lit(False)), message) for rule, bad, message in found]


def compile_all(df: DataFrame, schema: Mapping[str, Mapping[str, Any]]) -> list[Check]:
    """Checks of all columns that have rules."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return [x for name, r in schema.items() if name in kinds and isinstance(r, Mapping) for x in compile_checks(name, r, kinds[name])]


def _unpivot(aggregated: DataFrame, keys: list[str], rows: list[Column], empty: str) -> DataFrame:
    if not rows:
        return aggregated.sparkSession.createDataFrame([], empty)
    return aggregated.select(*keys, F.explode(F.array(*rows)).alias("x")).select(*keys, "x.*")


def count_violations(df: DataFrame, schema: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """column_name, rule and violations of every rule, from one aggregate over the data."""
    checks = compile_all(df, schema)
    counted = df.agg(F.count("*").alias("n"), *(F.count_if(x.bad).alias(f"v{i}") for i, x in enumerate(checks)))
    rows = [F.struct(F.lit(x.column).alias("column_name"), F.lit(x.rule).alias("rule"), F.col(f"v{i}").alias("violations")) for i, x in enumerate(checks)]
    return _unpivot(counted, [], rows, "column_name string, rule string, violations bigint")


def count_by_collection(df: DataFrame, schemas: Mapping[str, Mapping[str, Mapping[str, Any]]], column: str = "collection") -> DataFrame:
    """The same for each collection with the rules of its own: one conditional aggregate, no pass per collection."""
    found = [(cid, x) for cid, schema in schemas.items() for x in compile_all(df, schema)]
    here = [ref(column).eqNullSafe(F.lit(cid)) & x.bad for cid, x in found]
    # Rows of other collections need not be read.
    counted = df.filter(ref(column).isin(list(schemas))).agg(F.count("*").alias("n"), *(F.count_if(b).alias(f"v{i}") for i, b in enumerate(here)))
    rows = [F.struct(F.lit(cid).alias("collection"), F.lit(x.column).alias("column_name"), F.lit(x.rule).alias("rule"), F.col(f"v{i}").alias("violations")) for i, (cid, x) in enumerate(found)]
    return _unpivot(counted, [], rows, "collection string, column_name string, rule string, violations bigint")


def first_violations(df: DataFrame, schema: Mapping[str, Mapping[str, Any]], order: Column, where: Callable[[Check], Column] | None = None) -> DataFrame:
    """column_name, rule, violations, first_value (as text, of the smallest ``order``) and the message about it."""
    checks = compile_all(df, schema)
    shown = lambda x: geometry_type(ref(x.column)) if x.rule == "geometryTypes" else ref(x.column).cast("string")
    bad = [x.bad & where(x) if where else x.bad for x in checks]
    aggs = [a for i, x in enumerate(checks) for a in (F.count_if(bad[i]).alias(f"v{i}"), F.min_by(F.when(bad[i], shown(x)), F.when(bad[i], order)).alias(f"f{i}"))]
    counted = df.agg(F.count("*").alias("n"), *aggs)
    rows = [
        F.struct(
            F.lit(x.column).alias("column_name"),
            F.lit(x.rule).alias("rule"),
            F.col(f"v{i}").alias("violations"),
            F.col(f"f{i}").alias("first_value"),
            F.when(F.col(f"v{i}") > 0, F.replace(F.lit(x.message), F.lit("{v}"), F.coalesce(F.col(f"f{i}"), F.lit("")))).alias("message"),
        )
        for i, x in enumerate(checks)
    ]
    return _unpivot(counted, [], rows, "column_name string, rule string, violations bigint, first_value string, message string")


def first_issues(df: DataFrame, schemas: Mapping[str | None, Mapping[str, Mapping[str, Any]]], order: Column, column: str = "collection") -> list[str]:
    """Messages about the first offending value of each column of each collection: all rules that this value breaks. Rules
    under None hold for all rows. One aggregate finds all of them."""
    wanted: list[tuple[str, list[Check], Column]] = []
    for cid, schema in schemas.items():
        here = F.lit(True) if cid is None else ref(column).eqNullSafe(F.lit(cid))
        by_column: dict[str, list[Check]] = {}
        for x in compile_all(df, schema):
            by_column.setdefault(x.column, []).append(x)
        wanted += [(schema[name].get("type"), xs, here & reduce(Column.__or__, [x.bad for x in xs])) for name, xs in by_column.items()]
    if not wanted:
        return []
    shown = lambda kind, name: geometry_type(ref(name)) if kind == "geometry" else ref(name).cast("string")
    cells = [F.struct(shown(kind, xs[0].column).alias("v"), *(x.bad.alias(f"b{k}") for k, x in enumerate(xs))) for kind, xs, _ in wanted]
    row = df.agg(*(F.min_by(F.when(bad, cell), F.when(bad, order)).alias(f"c{i}") for i, (cell, (_, _, bad)) in enumerate(zip(cells, wanted, strict=True)))).first()
    return [f"{x.column}: {x.message.replace('{v}', str(row[i]['v']))}" for i, (_, xs, _) in enumerate(wanted) if row[i] for k, x in enumerate(xs) if row[i][f"b{k}"]]
