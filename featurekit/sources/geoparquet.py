"""GeoParquet source and sink (S1, S17, K1-K5 of the inventory). Spark's own Parquet writer can't add footer keys, so an Arrow
data source writes the files; it commits by renaming, so a lost task leaves nothing behind."""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass
from itertools import accumulate, count
from pathlib import Path
from typing import Any

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import BinaryType, StructType

from featurekit.functions import crs as crs_
from featurekit.functions import geometry as g
from featurekit.functions.text import format_filesize
from featurekit.functions.wkb import from_wkb, to_wkb
from featurekit.operators.columns import check_duplicates, ref
from featurekit.schema.collection import Collection, dehydrate
from featurekit.schema.collection import hydrate as fill
from featurekit.table import FeatureTable

#: Rows of a row group, compression where none is chosen, and versions. Fixed values.
ROW_GROUP, COMPRESSION, LEVEL, VERSIONS, VERSION = 25_000, "zstd", 15, ("1.0.0", "1.1.0"), "1.1.0"


def scratch_path(spark: SparkSession) -> str:
    """A new folder beneath the shared checkpoint folder, or beneath the warehouse where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base}/featurekit-{uuid.uuid4().hex}"


def filesystem(path: str) -> tuple[Any, str]:
    """The Arrow file system of a path, and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), str(path))


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: Mapping[str, str], overwrite: bool):
        self.options, self.overwrite = dict(options), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        import pyarrow.parquet as pq

        fs, root = filesystem(self.options["path"])
        fs.create_dir(f"{root}/_temporary", recursive=True)
        kinds = pa.ipc.read_schema(pa.py_buffer(bytes.fromhex(self.options["arrow"])))
        name = f"part-{uuid.uuid4().hex}.parquet"
        codec = self.options["compression"]
        level = int(self.options["level"]) if self.options.get("level") and codec in ("zstd", "gzip", "brotli") else None
        writer, held = None, []
        try:
            for batch in iterator:
                if writer is None:
                    writer = pq.ParquetWriter(f"{root}/_temporary/{name}", kinds, compression=codec, compression_level=level, filesystem=fs)
                held.append(batch)
                if sum(b.num_rows for b in held) >= ROW_GROUP:
                    # Full row groups only; what is left over waits for the next batches.
                    rows = pa.Table.from_batches(held)
                    full = rows.num_rows // ROW_GROUP * ROW_GROUP
                    writer.write_table(rows.slice(0, full).cast(kinds), row_group_size=ROW_GROUP)
                    held = rows.slice(full).to_batches()
            if held:
                writer.write_table(pa.Table.from_batches(held).cast(kinds), row_group_size=ROW_GROUP)
        finally:
            if writer is not None:
                writer.close()
        return Written([(f"{root}/_temporary/{name}", f"{root}/{name}")] if writer is not None else [])

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = filesystem(self.options["path"])
        files = [f for m in messages if m for f in m.files]
        single = self.options.get("single")
        for source, target in files:
            fs.move(source, single or target)
        if not files:
            kinds = pa.ipc.read_schema(pa.py_buffer(bytes.fromhex(self.options["arrow"])))
            pq.write_table(kinds.empty_table(), single or f"{root}/part-empty.parquet", filesystem=fs)
        fs.delete_dir(f"{root}/_temporary") if fs.get_file_info(f"{root}/_temporary").is_file is False else None

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, _ = filesystem(self.options["path"])
        for m in messages:
            for source, _target in m.files if m else ():
                if fs.get_file_info(source).is_file:
                    fs.delete_file(source)


class GeoParquetSink(DataSource):
    """The data source "geoparquet" for writing."""

    @classmethod
    def name(cls) -> str:
        return "geoparquet"

    def schema(self) -> str:
        return "geometry binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, overwrite)


def projjson(crs: str | int | None) -> dict[str, Any] | None:
    """A minimal description of the system, by its authority's code."""
    code = crs_.code(crs)
    if code is None:
        return None
    geographic = crs_.is_degrees(code)
    return {"$schema": "https://proj.org/schemas/v0.7/projjson.schema.json", "type": "GeographicCRS" if geographic else "ProjectedCRS", "name": "WGS 84" if code == 4326 else f"EPSG:{code}", "id": {"authority": "EPSG", "code": code}}


def geo_metadata(kinds: list[str], box: list[float] | None, crs: str | None, version: str, geom: str = "geometry") -> dict[str, Any]:
    column: dict[str, Any] = {"encoding": "WKB", "crs": projjson(crs), "geometry_types": sorted(kinds)}
    if box:
        column["bbox"] = box
    if version != "1.0.0":
        column["covering"] = {"bbox": {k: ["bbox", k] for k in ("xmin", "ymin", "xmax", "ymax")}}
    return {"version": version, "primary_column": geom, "columns": {geom: column}}


def _arrow_of(df: DataFrame, properties: Mapping[str, Any], required: set[str]) -> pa.Schema:
    """The file's Arrow schema: of the property's type where there is one, else of Spark's."""
    from pyspark.sql.pandas.types import to_arrow_type

    from featurekit.types import SCALARS, arrow_type

    fields = []
    for f in df.schema.fields:
        kind = to_arrow_type(f.dataType)
        if f.name in properties and (properties[f.name].get("type") in SCALARS or properties[f.name].get("type") in ("array", "object")):
            kind = arrow_type(properties[f.name])
        elif pa.types.is_timestamp(kind):
            kind = pa.timestamp("ms", tz="UTC")
        fields.append(pa.field(f.name, kind, f.name not in required))
    return pa.schema(fields)


def write_geoparquet(t: FeatureTable, path: str, properties: Iterable[str] | None = None, schema_map: Mapping[str, Any] | None = None, shrink: bool = True, compression: str | None = COMPRESSION, level: int | None = None, version: str | None = VERSION, single_file: bool = False, full: bool = False) -> None:
    """Files of ``path`` (one file at ``path`` with ``single_file``): constants as metadata, columns in their schema's
    types, geometry as WKB, and a covering ``bbox`` column last unless the version is 1.0.0. One aggregate gathers the
    footer's geometry types and bounds. With ``full`` the files have no more row groups than one file would. Geometries with Z are an error; duplicate names are one too."""
    from featurekit.types import cast_to_schema

    version = version if version in VERSIONS else VERSION
    keep = list(properties) if properties else None
    t = dehydrate(t, keep, schema_map) if shrink else t
    names = [c for c in t.columns if c != "bbox" and (keep is None or c in keep or c in (t.geometry, "id", "collection"))]
    check_duplicates(names)
    schema = t.collection.merged_schema(schema_map)
    df = cast_to_schema(t.df.select(*(ref(n) for n in names)), schema["properties"])
    shape = F.col(t.geometry)
    row = df.select(g.bounds(shape).alias("b"), g.geometry_type(shape).alias("k"), g.has_z(shape).alias("z")).agg(F.min("b.xmin"), F.min("b.ymin"), F.max("b.xmax"), F.max("b.ymax"), F.collect_set("k"), F.bool_or("z")).first()
    if row[5]:
        raise ValueError("Geometries with three dimensions are not supported")
    out = df.withColumn(t.geometry, to_wkb(shape))
    if version != "1.0.0":
        out = df.withColumns({"bbox": g.bounds(shape), t.geometry: to_wkb(shape)})
    required = {n for n in schema["required"] if len(t.collection.schemas) <= 1 and n in names}
    footer = {"geo": json.dumps(geo_metadata(row[4], list(row)[:4] if row[0] is not None else None, t.crs, version, t.geometry)), "collection": json.dumps(dict(t.collection))}
    arrow = _arrow_of(out, schema["properties"], required).with_metadata(footer)
    options = {"path": str(Path(path).parent / f".{Path(path).name}.parts") if single_file else path, "compression": compression or "none", "level": str(level or (LEVEL if compression == "zstd" else "")), "arrow": arrow.serialize().to_pybytes().hex()}
    if full and not single_file:
        out = full_groups(out)
    if single_file:
        out, options["single"] = out.coalesce(1), str(path)
    df.sparkSession.dataSource.register(GeoParquetSink)
    out.write.format("geoparquet").mode("append").options(**options).save()
    if single_file:
        Path(options["path"]).exists() and Path(options["path"]).rmdir()


#: Row groups of a bucket that ``full_groups`` deals.
DEALT = 4


def full_groups(df: DataFrame) -> DataFrame:
    """The same rows, dealt so that all files written of them together have as few row groups as one file would: rows are
    numbered, and a task gets whole buckets of ``DEALT`` full groups, of which the last alone may not be full. The driver
    gets a count for each partition."""
    spark = df.sparkSession
    part, place, before = (next(n for k in count() if (n := f"{stem}_{k}") not in {c.lower() for c in df.columns}) for stem in ("part", "place", "before"))
    at = df.withColumn(place, F.monotonically_increasing_id()).withColumn(part, F.shiftright(F.col(place), 33))
    counts = sorted((r[0], r[1]) for r in df.select(F.shiftright(F.monotonically_increasing_id(), 33).alias("p")).groupBy("p").count().collect())
    ends = list(accumulate((n for _, n in counts), initial=0))
    firsts = spark.createDataFrame([(p, n) for (p, _), n in zip(counts, ends, strict=False)], f"`{part}` bigint, `{before}` bigint")
    bucket = F.floor((F.col(before) + F.col(place).bitwiseAND((1 << 33) - 1)) / (DEALT * ROW_GROUP))
    numbered = at.join(F.broadcast(firsts), part).withColumn(part, bucket)
    return numbered.repartition(max(1, -(-ends[-1] // (DEALT * ROW_GROUP))), part).select(*(ref(c) for c in df.columns))


@dataclass
class Footer:
    """What a file's footer says."""

    geo: dict[str, Any] | None
    collection: Collection
    schema: pa.Schema
    rows: int
    groups: int
    columns: int
    compression: str | None
    size: int


#: Files of a folder up to which the driver reads footers itself.
FEW = 32


def _files(path: str) -> tuple[Any, list[str], str]:
    """The file system, the Parquet files of a path within it, and what their names lack for Spark."""
    from pyarrow import fs as pafs

    fs, root = filesystem(path)
    info = fs.get_file_info(root)
    if info.type.name == "NotFound":
        raise FileNotFoundError(path)
    inner = [] if info.is_file else fs.get_file_info(pafs.FileSelector(root))
    files = [root] if info.is_file else sorted(x.path for x in inner if x.is_file and x.base_name.endswith(".parquet"))
    if not files:
        raise FileNotFoundError(path)
    return fs, files, path.removesuffix(root) if path.endswith(root) else ""


def _box_of(meta: Any, geo: Mapping[str, Any] | None) -> list[float | None]:
    """The box of a file's geometries: by the statistics of its covering column, else as its metadata state it."""
    at = {meta.schema.column(i).path: i for i in range(meta.num_columns)}
    names = ["bbox.xmin", "bbox.ymin", "bbox.xmax", "bbox.ymax"]
    if all(n in at for n in names):
        groups = [[meta.row_group(k).column(at[n]).statistics for n in names] for k in range(meta.num_row_groups)]
        # A group that has nulls only has no box; one without statistics may be anywhere.
        boxes = [s for s in groups if not all(x is not None and not x.num_values for x in s)]
        if all(x is not None and x.has_min_max for s in boxes for x in s):
            if not boxes:
                return [math.inf, math.inf, -math.inf, -math.inf]
            low = [min(s[k].min for s in boxes) for k in (0, 1)]
            return low + [max(s[k].max for s in boxes) for k in (2, 3)]
    stated = (geo or {}).get("columns", {}).get((geo or {}).get("primary_column", "geometry"), {}).get("bbox")
    if not stated:
        return [None] * 4
    half = len(stated) // 2
    return [*stated[:2], *stated[half : half + 2]]


def footers(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file: file, rows, row groups, bytes and the box of its geometries (null if unknown). Tasks read the
    footers; the driver lists names."""
    _, files, prefix = _files(path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _root = filesystem(path)
        for b in batches:
            rows = []
            for name in b.column(0).to_pylist():
                meta = pq.read_metadata(name, filesystem=fs)
                raw = (meta.metadata or {}).get(b"geo")
                rows.append((prefix + name, meta.num_rows, meta.num_row_groups, fs.get_file_info(name).size, *_box_of(meta, json.loads(raw) if raw else None)))
            yield pa.RecordBatch.from_pylist([dict(zip(_FOOTERS.names, r, strict=True)) for r in rows], _FOOTERS)

    names = spark.createDataFrame([(f,) for f in files], "file string").repartition(min(len(files), max(spark.sparkContext.defaultParallelism, len(files) // 100)))
    return names.mapInArrow(read, "file string, rows bigint, groups bigint, size bigint, xmin double, ymin double, xmax double, ymax double")


_FOOTERS = pa.schema([("file", pa.string()), *((n, pa.int64()) for n in ("rows", "groups", "size")), *((n, pa.float64()) for n in ("xmin", "ymin", "xmax", "ymax"))])


def footer(path: str, spark: SparkSession | None = None, sums: bool = True) -> Footer:
    """Of a file, or of the first file of a folder; with rows, row groups and bytes of all its files, unless only the first
    is asked for. With a session, tasks read those of many files."""
    fs, files, _ = _files(path)
    first = pq.ParquetFile(files[0], filesystem=fs)
    if not sums:
        files = files[:1]
    raw = first.schema_arrow.metadata or {}
    read = lambda k: json.loads(raw[k]) if k in raw else None
    codecs = {first.metadata.row_group(0).column(i).compression.lower() for i in range(first.metadata.num_columns)} if first.metadata.num_row_groups else set()
    codec = None if not codecs or codecs == {"uncompressed"} else codecs.pop() if len(codecs) == 1 else "mixed"
    if spark is not None and len(files) > FEW:
        rows, groups, size = footers(spark, path).agg(F.sum("rows"), F.sum("groups"), F.sum("size")).first()
    else:
        metas = [first.metadata, *(pq.read_metadata(f, filesystem=fs) for f in files[1:])]
        rows, groups = sum(m.num_rows for m in metas), sum(m.num_row_groups for m in metas)
        size = sum(fs.get_file_info(f).size for f in files)
    return Footer(read(b"geo"), Collection(read(b"collection") or {}), first.schema_arrow, rows, groups, first.metadata.num_columns, codec, size)


def column_types(f: Footer) -> dict[str, list[str]]:
    return {x.name: [str(x.type), *(["null"] if x.nullable else [])] for x in f.schema}


def summary(f: Footer) -> dict[str, Any]:
    return {"Format": f"GeoParquet, version {(f.geo or {}).get('version', 'unknown')}", "Size": format_filesize(f.size), "Compression": f.compression, "Columns": f.columns, "Rows": f.rows, "Row Groups": f.groups}


def crs_of(geo: Mapping[str, Any] | None) -> str | None:
    """The system of the primary column; none stated means longitude and latitude."""
    column = (geo or {}).get("columns", {}).get((geo or {}).get("primary_column", "geometry"), {})
    if "crs" not in column:
        return "EPSG:4326"
    ident = (column["crs"] or {}).get("id")
    return f"{ident['authority']}:{ident['code']}" if ident else None


def _meets(box: Column, wanted: tuple[float, float, float, float]) -> Column:
    return (box["xmin"] <= wanted[2]) & (box["xmax"] >= wanted[0]) & (box["ymin"] <= wanted[3]) & (box["ymax"] >= wanted[1])


def read_geoparquet(
    spark: SparkSession,
    path: str,
    num: int | None = None,
    properties: Iterable[str] | None = None,
    schema_map: Mapping[str, Any] | None = None,
    hydrate: bool = False,
    box: tuple[float, float, float, float] | None = None,
) -> FeatureTable:
    """A table; named columns that exist (none named: all) and the first ``num`` rows (0 gives none). Selection reaches the
    scan, and so do filters on ``bbox``; the WKB is decoded only where the geometry is used.

    With a ``box`` (xmin, ymin, xmax, ymax) only rows whose bounds meet it: files whose box lies apart are not planned, row
    groups are left out by their statistics where there is a covering column."""
    f = footer(path, sums=False)
    geom = (f.geo or {}).get("primary_column", "geometry")
    if box is None:
        df = spark.read.parquet(path)
    else:
        at = F.struct("xmin", "ymin", "xmax", "ymax")
        near = [r["file"] for r in footers(spark, path).filter(F.col("xmin").isNull() | _meets(at, box)).select("file").collect()]
        df = spark.read.parquet(*sorted(near)) if near else spark.read.parquet(path).filter(F.lit(False))
        covered = "bbox" in df.columns and {"xmin", "ymin", "xmax", "ymax"} <= set(getattr(df.schema["bbox"].dataType, "names", ()))
        df = df.filter(_meets(F.col("bbox"), box)) if covered else df.filter(_meets(g.bounds(from_wkb(F.col(geom))), box))
    wanted = set(properties or ())
    df = df.select(*(ref(c) for c in df.columns if not wanted or c in wanted))
    if num is not None and num >= 0:
        df = df.limit(num)
    if geom in df.columns and isinstance(df.schema[geom].dataType, BinaryType):
        df = df.withColumn(geom, from_wkb(F.col(geom)))
    t = FeatureTable(df, f.collection, crs_of(f.geo), geom)
    return fill(t, schema_map) if hydrate else t
