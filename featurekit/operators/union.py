"""Concatenation of tables whose columns differ (U of the inventory)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, DoubleType, FractionalType, IntegralType, LongType, StringType, TimestampType

from featurekit.functions import crs as crs_
from featurekit.operators.columns import drop_null_columns, ref
from featurekit.table import FeatureTable


def common_type(a: DataType, b: DataType) -> DataType:
    """A type that holds values of both; text where nothing closer does."""
    if a == b:
        return a
    if isinstance(a, IntegralType) and isinstance(b, IntegralType):
        return LongType()
    if isinstance(a, (IntegralType, FractionalType)) and isinstance(b, (IntegralType, FractionalType)):
        return DoubleType()
    if {type(a), type(b)} == {DateType, TimestampType}:
        return TimestampType()
    return StringType()


def union(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of all frames, columns by name, missing ones null; differing types are cast first, as a union of text and
    numbers would fail only when it runs."""
    kinds: dict[str, DataType] = {}
    for df in frames:
        for f in df.schema.fields:
            kinds[f.name] = common_type(kinds.get(f.name, f.dataType), f.dataType)
    cast = [df.select(*(ref(f.name) if f.dataType == kinds[f.name] else ref(f.name).cast(kinds[f.name]).alias(f.name) for f in df.schema.fields)) for df in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cast)


def merge(tables: Sequence[FeatureTable], crs: str | None = None, properties: Sequence[str] | None = None) -> FeatureTable:
    """Tables as one: metadata become columns, geometries move to the first table's system (or ``crs``), columns unite,
    all-null ones go; nothing is de-duplicated. The schema lists unite, of equal ids the last one's stays."""
    from featurekit.schema.collection import hydrate, merge_collections

    target = crs or next((t.crs for t in tables if t.crs), None)
    parts = []
    for t in tables:
        t = hydrate(t)
        if t.crs and target and crs_.code(t.crs) != crs_.code(target) and t.geometry in t.columns:
            t = t.with_(df=t.df.withColumn(t.geometry, crs_.reproject(F.col(t.geometry), t.crs, target)))
        parts.append(t.df)
    return FeatureTable(drop_null_columns(union(parts)), merge_collections([t.collection for t in tables], properties), target)
