"""Projections, renames, constant columns and filters (P, X and F of the inventory)."""

from __future__ import annotations

import datetime
import decimal
import re
import warnings
from collections.abc import Callable, Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType, VariantType

CORE = ("id", "geometry", "collection")
Mask = Callable[[Column], "Column | tuple[Column, bool]"]


def ref(name: str) -> Column:
    """A column by its whole name, dots and colons included."""
    return F.col(f"`{name.replace('`', '``')}`")


def select_existing(df: DataFrame, names: Iterable[str] | None) -> DataFrame:
    """The named columns that exist, in the frame's order; no names mean all."""
    wanted = set(names or ())
    return df.select(*(ref(c) for c in df.columns if c in wanted)) if wanted else df


def merge_projection(df: DataFrame, includes: Iterable[str] = (), excludes: Iterable[str] = ()) -> DataFrame:
    """Core columns and ``includes`` without ``excludes``, as far as they exist."""
    return df.select(*(ref(c) for c in df.columns if c in ({*CORE, *includes} - set(excludes))))


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Names that do not exist are ignored; renaming core or schema-bound columns warns."""
    for old in mapping:
        if old in CORE or ":" in old:
            warnings.warn(f"Renaming '{old}' may make the data non-compliant", stacklevel=2)
    return df.withColumnsRenamed(dict(mapping))


def map_columns(df: DataFrame, mapping: Mapping[str, str | Sequence[str]]) -> DataFrame:
    """Only mapped columns, under their new names; a list of names gives as many copies. Missing sources warn."""
    out = []
    for old, new in mapping.items():
        if old not in df.columns:
            warnings.warn(f"Column '{old}' not found", stacklevel=2)
            continue
        out += [ref(old).alias(n) for n in ([new] if isinstance(new, str) else new)]
    result = df.select(*out)
    check_duplicates(result.columns)
    return result


def check_duplicates(names: Sequence[str]) -> None:
    twice = sorted({n for n in names if list(names).count(n) > 1})
    if twice:
        raise ValueError(f"Duplicate column names: {', '.join(twice)}")


def literal(value: Any) -> Column:
    """A constant of any JSON-like value: scalars as they are, lists as arrays, mappings as structs."""
    if isinstance(value, Mapping):
        return F.struct(*(literal(v).alias(str(k)) for k, v in value.items()))
    if isinstance(value, (list, tuple, set)):
        return F.array(*map(literal, value))
    return F.lit(value)


def add_constants(df: DataFrame, constants: Mapping[str, Any], collection: str | None = None) -> DataFrame:
    """Constant columns, and the collection's id where one is given."""
    added = {k: literal(v) for k, v in constants.items()} | ({"collection": F.lit(collection)} if collection is not None else {})
    return df.withColumns(added) if added else df


def admin_columns(country: str, subdivision: str | None = None) -> dict[str, str]:
    """Constants of administrative division. The country may be the start of a collection's id ("de_nrw")."""
    code = re.split(r"[_\-]", country)[0].upper()
    if not re.fullmatch("[A-Z]{2}", code):
        raise ValueError(f"Invalid country code: {country}")
    return {"admin:country_code": code} | ({"admin:subdivision_code": subdivision} if subdivision else {})


def migrate_columns(df: DataFrame, migrations: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """Each function applied to its column; missing columns warn."""
    for name in set(migrations) - set(df.columns):
        warnings.warn(f"Column '{name}' not found", stacklevel=2)
    found = {k: fn(ref(k)) for k, fn in migrations.items() if k in df.columns}
    return df.withColumns(found) if found else df


def filter_rows(df: DataFrame, filters: Mapping[str, Mask]) -> DataFrame:
    """Rows that all masks hold for. A mask may come with True to invert it; what is unknown is false before that, as in
    two-valued logic. Missing columns warn, and their filter is skipped."""
    for name, fn in filters.items():
        if name not in df.columns:
            warnings.warn(f"Column '{name}' not found", stacklevel=2)
            continue
        found = fn(ref(name))
        mask, invert = found if isinstance(found, tuple) else (found, False)
        mask = F.coalesce(mask, F.lit(False))
        df = df.filter(~mask if invert else mask)
    return df


def index_as_id(df: DataFrame, name: str = "id") -> DataFrame:
    """Rows of a scan numbered from 0 in its order. Partitions count their rows first (one number each reaches the
    driver), so no row is sorted or moved."""
    df = df.drop(name).withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    counts = {r["__part"]: r["count"] for r in df.groupBy("__part").count().collect()}
    offsets, total = [], 0
    for part in range(max(counts, default=-1) + 1):
        offsets.append(total)
        total += counts.get(part, 0)
    start = F.get(F.split(F.lit(",".join(map(str, offsets)) or "0"), ",").cast("array<bigint>"), F.col("__part"))
    return df.withColumn(name, start + F.col("__at")).drop("__part", "__at")


def constant_profile(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """One row: n, and for each scalar column its non-null count, minimum and maximum, from one pass without a distinct."""
    aggs = [F.count("*").alias("n")]
    for c in columns or scalar_columns(df):
        aggs += [F.count(ref(c)).alias(f"{c}\x00n"), F.min(ref(c)).alias(f"{c}\x00lo"), F.max(ref(c)).alias(f"{c}\x00hi")]
    return df.agg(*aggs)


def scalar_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, (ArrayType, MapType, StructType, VariantType)) and f.dataType.typeName() != "binary"]


def constants_of(df: DataFrame, columns: Iterable[str]) -> dict[str, Any]:
    """Values of the columns that are the same in every row, null included; nothing of a frame of one row or none."""
    names = [c for c in columns if c in scalar_columns(df)]
    row = constant_profile(df, names).first() if names else None
    if row is None or row["n"] <= 1:
        return {}
    return {c: row[f"{c}\x00lo"] for c in names if row[f"{c}\x00n"] == 0 or (row[f"{c}\x00n"] == row["n"] and row[f"{c}\x00lo"] == row[f"{c}\x00hi"])}


def jsonable(value: Any) -> Any:
    if isinstance(value, datetime.datetime):
        return value.isoformat() + "Z" if value.utcoffset() is None else value.isoformat().replace("+00:00", "Z")
    if isinstance(value, datetime.date):
        return value.isoformat()
    return float(value) if isinstance(value, decimal.Decimal) else value


def drop_null_columns(df: DataFrame) -> DataFrame:
    """Without the columns that are null in every row; one pass counts all of them."""
    counts = df.agg(*(F.count(ref(c)).alias(f"c{i}") for i, c in enumerate(df.columns))).first()
    return df.select(*(ref(c) for i, c in enumerate(df.columns) if counts[i]))
