"""Schema types as Spark and Arrow types."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featurekit.functions.geometry import BBOX_DDL, DDL
from featurekit.operators.columns import ref

#: Spark and Arrow types of the scalar types. Unsigned ones take the next wider Spark type, and a range check.
SCALARS: dict[str, tuple[T.DataType, pa.DataType]] = {
    "boolean": (T.BooleanType(), pa.bool_()),
    "int8": (T.ByteType(), pa.int8()),
    "uint8": (T.ShortType(), pa.uint8()),
    "int16": (T.ShortType(), pa.int16()),
    "uint16": (T.IntegerType(), pa.uint16()),
    "int32": (T.IntegerType(), pa.int32()),
    "uint32": (T.LongType(), pa.uint32()),
    "int64": (T.LongType(), pa.int64()),
    "uint64": (T.DecimalType(20, 0), pa.uint64()),
    "float": (T.FloatType(), pa.float32()),
    "double": (T.DoubleType(), pa.float64()),
    "binary": (T.BinaryType(), pa.binary()),
    "string": (T.StringType(), pa.string()),
    "date": (T.DateType(), pa.date32()),
    "date-time": (T.TimestampType(), pa.timestamp("ms", tz="UTC")),
}


def spark_type(schema: Mapping[str, Any]) -> T.DataType:
    """The Spark type of a property; types that no column can have raise."""
    kind = schema.get("type")
    if kind in SCALARS:
        return SCALARS[kind][0]
    if kind == "array":
        return T.ArrayType(spark_type(schema["items"]))
    if kind == "geometry":
        return T._parse_datatype_string(DDL)
    if kind == "bounding-box":
        return T._parse_datatype_string(BBOX_DDL)
    if kind == "object":
        if schema.get("additionalProperties") is True:
            raise ValueError("Objects of arbitrary properties can't be a column")
        if isinstance(schema.get("additionalProperties"), Mapping):
            return T.MapType(T.StringType(), spark_type(schema["additionalProperties"]))
        if patterns := schema.get("patternProperties"):
            if len(patterns) > 1:
                raise ValueError("Only one pattern of properties is supported")
            return T.MapType(T.StringType(), spark_type(next(iter(patterns.values()))))
        required = set(schema.get("required", []))
        return T.StructType([T.StructField(k, spark_type(v), k not in required) for k, v in schema.get("properties", {}).items()])
    raise ValueError(f"Unsupported type: {kind}")


def arrow_type(schema: Mapping[str, Any]) -> pa.DataType:
    """The Arrow type that is written."""
    kind = schema.get("type")
    if kind in SCALARS:
        return SCALARS[kind][1]
    if kind == "array":
        return pa.list_(arrow_type(schema["items"]))
    if kind == "geometry":
        return pa.binary()
    if kind == "bounding-box":
        return pa.struct([(x, pa.float64()) for x in ("xmin", "ymin", "xmax", "ymax")])
    spark = spark_type(schema)
    if isinstance(spark, T.MapType):
        return pa.map_(pa.string(), arrow_type(schema.get("additionalProperties") or next(iter(schema["patternProperties"].values()))))
    required = set(schema.get("required", []))
    return pa.struct([pa.field(k, arrow_type(v), k not in required) for k, v in schema.get("properties", {}).items()])


def try_cast(column: Column, source: T.DataType, target: T.DataType) -> Column:
    """A cast whose failures are null; nested types are cast as they are."""
    if source == target:
        return column
    return column.try_cast(target) if not isinstance(target, (T.StructType, T.MapType, T.ArrayType)) else column.cast(target)


def cast_to_schema(df: DataFrame, properties: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """Columns with a schema in its type; values that don't fit become null. Others stay."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    found = {}
    for name, p in properties.items():
        if name in kinds and p.get("type") not in (None, "geometry", "bounding-box"):
            found[name] = try_cast(ref(name), kinds[name], spark_type(p))
    return df.withColumns(found) if found else df


def count_lost(before: DataFrame, properties: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """One row: by column how many values a cast to the schema would lose."""
    after = cast_to_schema(before, properties)
    names = [n for n in properties if n in before.columns and properties[n].get("type") in SCALARS]
    kinds = {f.name: f.dataType for f in before.schema.fields}
    lost = [F.count_if(ref(n).isNotNull() & try_cast(ref(n), kinds[n], spark_type(properties[n])).isNull()).alias(n) for n in names]
    return before.agg(*lost) if lost else after.limit(0)
