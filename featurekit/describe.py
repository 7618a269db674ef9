"""Summaries of files (C7 of the inventory): footer, schemas, columns, metadata and the first rows."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from featurekit.functions.geometry import to_geojson
from featurekit.functions.text import format_filesize
from featurekit.schema.collection import Collection, parse_schemas
from featurekit.sources import geojson, geoparquet
from featurekit.sources.discover import encoding_of


def pretty(value: Any, depth: int = 0, most: int = 3, width: int = -1) -> list[str]:
    """Lines of nested values; deeper ones and long texts are cut."""
    pad, out = "  " * depth, []
    if isinstance(value, Mapping):
        for k, v in value.items():
            if isinstance(v, (Mapping, list, tuple, set)) and v:
                out += [f"{pad}{k}:", *(pretty(v, depth + 1, most, width) if depth + 1 < most else [f"{pad}  (omitted, {len(v)} items)"])]
            else:
                out.append(f"{pad}{k}: {_short(v, width)}")
    elif isinstance(value, (list, tuple, set)):
        for v in sorted(value) if isinstance(value, set) else value:
            out += [f"{pad}- {_short(v, width)}"] if not isinstance(v, (Mapping, list)) else [f"{pad}-", *pretty(v, depth + 1, most, width)]
    else:
        out.append(f"{pad}{_short(value, width)}")
    return out


def _short(v: Any, width: int) -> str:
    text = "none" if v is None or v == {} or v == [] else str(v)
    return text if width < 0 or len(text) <= width else text[: width - 3] + "..."


def schema_lines(collection: Collection) -> list[str]:
    if not collection.schemas:
        return ["Data not compliant to the specification or outdated, no version found"]
    out = []
    for cid, uris in collection.schemas.items():
        version, _, extensions = parse_schemas(uris)
        many = len(collection.schemas) > 1
        out += [f"Collection '{cid}':"] if many else []
        out += pretty({"Version": version, "Extensions": extensions or None}, int(many))
    return [*out, f"Custom Schemas: {'Yes' if 'schemas:custom' in collection else 'No'}"]


def describe(spark: SparkSession, path: str, num: int = 10, properties: Iterable[str] | None = None, verbose: bool = False) -> str:
    """The report as text. Only the footer and ``num`` rows are read."""
    kind = encoding_of(path)
    if "://" not in path and not Path(path).exists():
        raise FileNotFoundError(f"'{path}' is not available")
    if kind == "geoparquet":
        f = geoparquet.footer(path, spark)
        summary, collection, columns = geoparquet.summary(f), f.collection, geoparquet.column_types(f)
        read = lambda: geoparquet.read_geoparquet(spark, path, num, properties)
    else:
        collection, columns = geojson.metadata(spark, path), None
        summary = {"Format": "GeoJSON", "Size": format_filesize(Path(path).stat().st_size)}
        read = lambda: geojson.read_geojson(spark, path, num, properties)
    out = ["FILE SUMMARY", *pretty(summary), "", "VERSIONS & EXTENSIONS", *schema_lines(collection), "", "COLUMNS"]
    out += [f"{k}: {', '.join(v)}" for k, v in columns.items()] if columns else ["File format is not columnar"]
    rest = {k: v for k, v in collection.items() if k != "schemas" and (verbose or k != "schemas:custom")}
    out += ["", "COLLECTION DATA", *(pretty(rest, most=3 if verbose else 1, width=-1 if verbose else 50) if rest else ["Nothing found"]), "", "PER-GEOMETRY DATA"]
    if num > 0:
        t = read()
        df = t.df.withColumn(t.geometry, to_geojson(F.col(t.geometry))) if t.geometry in t.columns else t.df
        out.append(df.toPandas().to_string())
    else:
        out.append("Omitted")
    return "\n".join(out)
