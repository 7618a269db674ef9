"""GeoPackage layers (S6 of the inventory), read by ranges of row ids so that tasks share a layer."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from contextlib import closing

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from featurekit.functions.wkb import from_wkb

ROWS_PER_TASK = 100_000
#: Spark types of column types. Fixed values.
TYPES = {"BOOLEAN": "boolean", "TINYINT": "int", "SMALLINT": "int", "MEDIUMINT": "int", "INT": "bigint", "INTEGER": "bigint", "FLOAT": "double", "DOUBLE": "double", "REAL": "double", "BLOB": "binary", "DATE": "string", "DATETIME": "string"}


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _name(text: str) -> str:
    return '"' + text.replace('"', '""') + '"'


def layers(path: str) -> list[str]:
    with closing(_open(path)) as db:
        return [r[0] for r in db.execute("SELECT table_name FROM gpkg_contents WHERE data_type IN ('features', 'attributes') ORDER BY table_name")]


def describe(path: str, layer: str) -> tuple[list[tuple[str, str]], str | None, str | None]:
    """Columns with Spark types, the geometry column, and the layer's system."""
    with closing(_open(path)) as db:
        cols = [(r[1], TYPES.get(r[2].split("(")[0].upper(), "string")) for r in db.execute(f"PRAGMA table_info({_name(layer)})")]
        geom = db.execute("SELECT g.column_name, s.organization, s.organization_coordsys_id FROM gpkg_geometry_columns g LEFT JOIN gpkg_spatial_ref_sys s USING (srs_id) WHERE table_name = ?", (layer,)).fetchone()
    return cols, geom[0] if geom else None, f"{geom[1].upper()}:{geom[2]}" if geom and geom[1] else None


def wkb_of(blob: bytes | None) -> bytes | None:
    """The WKB after a blob's header, whose flags tell how long its envelope is; null for empty geometries."""
    if blob is None or blob[:2] != b"GP" or blob[3] & 0x10:
        return None
    return bytes(blob[8 + (0, 32, 48, 48, 64)[blob[3] >> 1 & 7] :])


class Range(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class _Reader(DataSourceReader):
    def __init__(self, path: str, layer: str, schema: StructType):
        self.path, self.layer, self.names = path, layer, schema.fieldNames()
        self.kinds = [f.dataType.simpleString() for f in schema.fields]
        self.geom = describe(path, layer)[1]

    def partitions(self) -> list[InputPartition]:
        with closing(_open(self.path)) as db:
            lo, hi = db.execute(f"SELECT min(rowid), max(rowid) FROM {_name(self.layer)}").fetchone()
        return [Range(a, min(a + ROWS_PER_TASK - 1, hi)) for a in range(lo, hi + 1, ROWS_PER_TASK)] if lo is not None else [Range(0, -1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        cast = {"bigint": int, "int": int, "double": float, "boolean": bool, "string": str, "binary": bytes}
        fns = [wkb_of if n == self.geom else cast[k] for n, k in zip(self.names, self.kinds, strict=True)]
        with closing(_open(self.path)) as db:
            for row in db.execute(f"SELECT {', '.join(map(_name, self.names))} FROM {_name(self.layer)} WHERE rowid BETWEEN ? AND ? ORDER BY rowid", (partition.lo, partition.hi)):
                yield tuple(None if v is None else fn(v) for fn, v in zip(fns, row, strict=True))


class GeoPackageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geopackage"

    def schema(self) -> str:
        cols, geom, _ = describe(self.options["path"], self.options["layer"])
        return ", ".join(f"`{n}` {'binary' if n == geom else k}" for n, k in cols)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self.options["layer"], schema)


def read(spark: SparkSession, path: str, layer: str) -> DataFrame:
    """A layer; its geometry column is called geometry. The file must lie where all executors read it."""
    spark.dataSource.register(GeoPackageSource)
    df = spark.read.format("geopackage").option("layer", layer).load(path)
    geom = describe(path, layer)[1]
    if not geom:
        return df
    names = [c for c in df.columns if c != geom]
    return df.select(*(F.col(f"`{c}`") for c in names), from_wkb(F.col(f"`{geom}`")).alias("geometry"))
