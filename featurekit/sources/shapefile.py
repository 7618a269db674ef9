"""Shapefiles (S6 of the inventory): geometries of the .shp, attributes of the .dbf, by the published layouts."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from featurekit.functions.geometry import DDL

ROWS_PER_TASK = 50_000


def shape(raw: bytes) -> tuple[str, list] | None:
    """A record's geometry, in two dimensions."""
    (kind,) = struct.unpack_from("<i", raw, 0)
    base = kind % 10
    if kind == 0:
        return None
    if base == 1:
        return "Point", [[[list(struct.unpack_from("<2d", raw, 4))]]]
    if base == 8:
        (n,) = struct.unpack_from("<i", raw, 36)
        return "MultiPoint", [[[p]] for p in np.frombuffer(raw, "<f8", 2 * n, 40).reshape(n, 2).tolist()]
    if base not in (3, 5):
        raise ValueError(f"Unsupported shape type: {kind}")
    parts, n = struct.unpack_from("<2i", raw, 36)
    starts = [*struct.unpack_from(f"<{parts}i", raw, 44), n]
    xy = np.frombuffer(raw, "<f8", 2 * n, 44 + 4 * parts).reshape(n, 2)
    lines = [xy[a:b] for a, b in zip(starts, starts[1:], strict=False)]
    if base == 3:
        return ("LineString", [[lines[0].tolist()]]) if parts == 1 else ("MultiLineString", [[x.tolist()] for x in lines])
    return _polygons(lines)


def _polygons(rings: list[np.ndarray]) -> tuple[str, list]:
    """Rings with the clock are shells; others are holes of the smallest shell around their first point."""
    from featurekit.functions.validity import inside

    area = [float((r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1]).sum() / 2) for r in rings]
    shells = [k for k, a in enumerate(area) if a <= 0] or list(range(len(rings)))
    out = {k: [rings[k].tolist()] for k in shells}
    for k in sorted(set(range(len(rings))) - set(shells)):
        owners = [s for s in shells if inside(rings[k][0], rings[s]) >= 0]
        out[min(owners, key=lambda s: abs(area[s])) if owners else shells[0]].append(rings[k].tolist())
    return ("Polygon" if len(out) == 1 else "MultiPolygon"), list(out.values())


def fields(dbf: str) -> tuple[int, int, int, list[tuple[str, str, int, int]]]:
    """Rows, header and row sizes, and (name, type, length, decimals) of the attributes."""
    with open(dbf, "rb") as f:
        rows, head, size = struct.unpack("<IHH", f.read(12)[4:12])
        f.seek(32)
        raw = f.read(head - 33)
    found = [raw[i : i + 32] for i in range(0, len(raw) - 31, 32)]
    return rows, head, size, [(x[:11].split(b"\0")[0].decode("latin-1"), chr(x[11]), x[16], x[17]) for x in found]


def _spark(kind: str, decimals: int) -> str:
    return {"N": "double" if decimals else "bigint", "F": "double", "L": "boolean"}.get(kind, "string")


def _value(kind: str, decimals: int, raw: bytes, encoding: str):
    text = raw.decode(encoding, "replace").strip("\0 ")
    if kind in "NF":
        return None if not text or text.startswith("*") else float(text) if decimals or kind == "F" else int(float(text))
    if kind == "L":
        return {"Y": True, "T": True, "N": False, "F": False}.get(text.upper())
    return text or None


class Slice(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class _Reader(DataSourceReader):
    def __init__(self, path: str, encoding: str):
        self.path, self.encoding = path, encoding

    def _side(self, suffix: str) -> str | None:
        return next((str(p) for p in (Path(self.path).with_suffix(s) for s in (suffix, suffix.upper())) if p.exists()), None)

    def partitions(self) -> list[InputPartition]:
        n = (Path(self._side(".shx")).stat().st_size - 100) // 8
        return [Slice(a, min(a + ROWS_PER_TASK, n)) for a in range(0, n, ROWS_PER_TASK)] or [Slice(0, 0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        dbf = self._side(".dbf")
        _, head, size, cols = fields(dbf) if dbf else (0, 0, 0, [])
        with open(self._side(".shx"), "rb") as f:
            f.seek(100 + 8 * partition.lo)
            index = np.frombuffer(f.read(8 * (partition.hi - partition.lo)), ">i4").reshape(-1, 2) * 2
        with open(self.path, "rb") as shp, open(dbf or "/dev/null", "rb") as att:
            att.seek(head + partition.lo * size)
            for offset, length in index.tolist():
                shp.seek(offset + 8)
                g = shape(shp.read(length))
                row, at, out = att.read(size), 1, []
                for _, kind, n, decimals in cols:
                    out.append(_value(kind, decimals, row[at : at + n], self.encoding))
                    at += n
                yield (*out, g)


class ShapefileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        dbf = next((str(p) for p in (Path(self.options["path"]).with_suffix(s) for s in (".dbf", ".DBF")) if p.exists()), None)
        cols = fields(dbf)[3] if dbf else []
        return ", ".join([*(f"`{n}` {_spark(k, d)}" for n, k, _, d in cols), f"geometry {DDL}"])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("encoding", "utf-8"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Attributes and geometry; the files must lie where all executors read them."""
    spark.dataSource.register(ShapefileSource)
    return spark.read.format("shapefile").load(path)
