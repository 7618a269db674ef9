"""Command line: one subcommand per operation, twelve in all."""

from __future__ import annotations

import argparse
import json
import re
import sys
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import SparkSession

from featurekit import describe as describe_
from featurekit import rename, stac
from featurekit.operators.improve import improve
from featurekit.operators.union import merge
from featurekit.plans import convert
from featurekit.registry import REGISTRY
from featurekit.schema import bundled, jsonschema
from featurekit.sources import geojson, geoparquet
from featurekit.sources.discover import expand
from featurekit.table import FeatureTable


def session() -> SparkSession:
    return SparkSession.builder.appName("featurekit").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def read(spark: SparkSession, path: str, **options) -> FeatureTable:
    return REGISTRY.encoding(path).read(spark, path, **options)


def write(t: FeatureTable, path: str, **options) -> None:
    REGISTRY.encoding(path).write(t, path, **options)


def _pairs(values: Sequence[str]) -> dict[str, str]:
    out = {}
    for v in values:
        old, eq, new = v.partition("=")
        if not eq or not old or not new:
            raise ValueError(f"Expected old=new, got {v}")
        out[old] = new
    return out


def _emit(value: object, target: str | None, indent: int | None = 2) -> None:
    text = json.dumps(value, indent=indent, ensure_ascii=False)
    Path(target).write_text(text, encoding="utf-8") if target else print(text)


def _writing(p: argparse.ArgumentParser) -> None:
    p.add_argument("-pc", "--compression", default="zstd", choices=["brotli", "gzip", "lz4", "snappy", "zstd", "none"])
    p.add_argument("-pl", "--compression-level", type=int)
    p.add_argument("-gp", "--geoparquet-version", default=geoparquet.VERSION, choices=geoparquet.VERSIONS)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="featurekit")
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, *args: str, out: bool = False) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        for a in args:
            p.add_argument(a.rstrip("+"), **({"nargs": "+"} if a.endswith("+") else {}))
        if out:
            p.add_argument("-o", "--out")
        p.add_argument("-m", "--schema-map", action="append", default=[])
        return p

    p = add("convert", "dataset", out=True)
    p.add_argument("-i", "--input", action="append", default=[])
    p.add_argument("-v", "--variant")
    p.add_argument("-c", "--cache")
    p.add_argument("--original-geometries", action="store_true")
    _writing(p)
    p = add("converters")
    p.add_argument("-p", "--providers", action="store_true")
    p = add("create-geojson", "source", out=True)
    p.add_argument("-f", "--features", action="store_true")
    p.add_argument("-n", "--num", type=int, default=-1)
    p.add_argument("-i", "--indent", type=int)
    p = add("create-geoparquet", "sources+", out=True)
    p.add_argument("-p", "--properties", action="append")
    _writing(p)
    p = add("jsonschema", "schema", out=True)
    p.add_argument("--id")
    p.add_argument("-d", "--datatypes")
    p = add("create-stac-collection", "source", out=True)
    p.add_argument("-t", "--temporal-property", default="determination:datetime")
    p.add_argument("-u", "--data-url")
    p = add("describe", "source")
    p.add_argument("-n", "--num", type=int, default=10)
    p.add_argument("-p", "--properties", action="append")
    p.add_argument("-v", "--verbose", action="store_true")
    p = add("improve", "source", out=True)
    p.add_argument("-r", "--rename-property", action="append", default=[])
    p.add_argument("-g", "--fix-geometries", action="store_true")
    p.add_argument("-e", "--explode-geometries", action="store_true")
    p.add_argument("-sz", "--add-sizes", action="store_true")
    p.add_argument("--crs")
    _writing(p)
    p = add("merge", "sources+", out=True)
    p.add_argument("--crs")
    p.add_argument("-i", "--include", action="append", default=[])
    p.add_argument("-e", "--exclude", action="append", default=[])
    _writing(p)
    p = add("rename-extension", "folder")
    for a in ("--title", "--prefix", "--slug", "--org", "--domain"):
        p.add_argument(a, required=a in ("--title", "--prefix"))
    p = add("validate", "sources+")
    p.add_argument("-n", "--num", type=int, default=100)
    p.add_argument("-r", "--require", action="append", default=[])
    p = add("validate-schema", "schemas+")
    p.add_argument("--metaschema")
    return top


def run(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """Runs a command; 0 if all went well, 1 if something is invalid."""
    a = parser().parse_args(argv)
    maps = bundled.parse_schema_map(a.schema_map)
    get = lambda: spark or session()
    parquet = lambda: {"compression": a.compression, "level": a.compression_level, "version": a.geoparquet_version, "schema_map": maps}
    if a.command == "convert":
        name = a.dataset if a.dataset.endswith(".py") or "." in a.dataset else f"{REGISTRY.converters}.{a.dataset}"
        convert.convert_file(get(), convert.load(name)(), a.out, compression=a.compression, level=a.compression_level, version=a.geoparquet_version, single_file=True, schema_map=maps, inputs=a.input or None, variant=a.variant, cache=a.cache, original_geometries=a.original_geometries)
    elif a.command == "converters":
        for name, found in convert.discover(REGISTRY.converters).items():
            print(f"{name}: {found}" if isinstance(found, Exception) else f"{name}: {found.short_name or found.title}" + (f" ({found.provider})" if a.providers and found.provider else ""))
    elif a.command == "create-geojson":
        if a.features:
            geojson.write_features(read(get(), a.source), a.out, a.num, schema_map=maps, indent=a.indent)
        else:
            t = read(get(), a.source, num=a.num if a.num >= 0 else None)
            geojson.write_geojson(t, a.out, schema_map=maps, indent=a.indent)
    elif a.command == "create-geoparquet":
        t = merge([read(get(), p, hydrate=True, schema_map=maps) for s in a.sources for p in expand(s)], properties=a.properties)
        geoparquet.write_geoparquet(t, a.out, a.properties, single_file=True, **parquet())
    elif a.command == "jsonschema":
        datatypes = bundled.load_file(a.datatypes) if a.datatypes else bundled.DATATYPES
        _emit(jsonschema.document(bundled.load_file(a.schema), datatypes.get("$defs", datatypes), a.id), a.out)
    elif a.command == "create-stac-collection":
        columnar = REGISTRY.encoding(a.source).columnar
        t = read(get(), a.source, properties=["geometry", a.temporal_property] if columnar else None)
        columns = geoparquet.column_types(geoparquet.footer(a.source)) if columnar else None
        href = a.data_url or "file://" + str(Path(a.source).resolve())
        _emit(stac.collection_document(t, href, "application/vnd.apache.parquet" if columnar else "application/geo+json", a.temporal_property, columns), a.out)
    elif a.command == "describe":
        print(describe_.describe(get(), a.source, a.num, a.properties, a.verbose))
    elif a.command == "improve":
        t = improve(read(get(), a.source), _pairs(a.rename_property), a.add_sizes, a.fix_geometries, a.explode_geometries, a.crs)
        write(t, a.out or a.source, **parquet())
    elif a.command == "merge":
        from featurekit.operators.columns import merge_projection

        t = merge([read(get(), p, hydrate=True, schema_map=maps) for s in a.sources for p in expand(s)], a.crs)
        write(t.transform(merge_projection, a.include, a.exclude), a.out, **parquet())
    elif a.command == "rename-extension":
        print("\n".join(rename.rename_extension(a.folder, rename.replacements(a.title, a.prefix, a.slug, a.org, a.domain))))
    elif a.command == "validate":
        required = REGISTRY.required_schemas + [re.compile(r) if any(c in r for c in "\\*+[(") else r for r in a.require]
        results = {p: REGISTRY.encoding(p).validate(get(), p, a.num, maps, required) for s in a.sources for p in expand(s)}
        for path, r in results.items():
            print("\n".join([f"{path}: {r.status}", *(f"  error: {x}" for x in r.errors), *(f"  warning: {x}" for x in r.warnings)]))
        return int(any(r.status != "VALID" for r in results.values()))
    elif a.command == "validate-schema":
        bad = False
        for path in a.schemas:
            found = jsonschema.validate_schema(bundled.load_file(path), bundled.load_file(a.metaschema) if a.metaschema else None)
            bad |= bool(found)
            print("\n".join([f"{path}: {'INVALID' if found else 'VALID'}", *(f"  {'.'.join(map(str, at))}: {m}" for at, m in found)]))
        return int(bad)
    return 0


def main() -> None:
    try:
        sys.exit(run())
    except Exception as e:
        sys.exit(f"Error: {e}")


if __name__ == "__main__":
    main()
