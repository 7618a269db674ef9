"""Declarative converters (C1, C2 and H of the inventory): a source dataset as one lazy plan, from scan to sorted features."""

from __future__ import annotations

import copy
import importlib
import importlib.util
import pkgutil
import warnings
from collections.abc import Callable, Mapping, Sequence
from pathlib import Path
from types import ModuleType
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featurekit.functions import geometry as g
from featurekit.operators import columns as c
from featurekit.operators.improve import fix_geometries, keep_valid_polygons
from featurekit.operators.union import union
from featurekit.schema.bundled import CORE
from featurekit.schema.collection import Collection
from featurekit.sources.discover import choose_sources, download, parse_input, read_layers, shared_folder
from featurekit.sources.geoparquet import write_geoparquet
from featurekit.table import FeatureTable


class Converter:
    """Subclasses say where the data lie and what its columns become; hooks change frames in between.

    ``columns`` maps source columns to one name or several; ``column_filters`` are masks on source columns,
    ``column_additions`` constants, ``column_migrations`` functions from column to column."""

    id: str = ""
    short_name: str = ""
    title: str = ""
    description: str = ""
    license: str | None = None
    attribution: str | None = None
    provider: str | None = None
    bbox: Sequence[float] | None = None
    sources: str | Mapping[str, Any] | None = None
    variants: Mapping[str, Any] = {}
    variant: str | None = None
    data_access: str = ""
    open_options: Mapping[str, str] = {}
    avoid_range_request: bool = False
    crs: str = "EPSG:4326"
    columns: Mapping[str, str | Sequence[str]] = {}
    column_additions: Mapping[str, Any] = {}
    column_filters: Mapping[str, c.Mask] = {}
    column_migrations: Mapping[str, Callable[[Column], Column]] = {}
    missing_schemas: Mapping[str, Any] = {}
    extensions: Sequence[str] = ()
    index_as_id: bool = False

    def __init__(self) -> None:
        # Instances own their containers, so a hook that changes one leaves the class alone.
        for name in ("variants", "columns", "column_additions", "column_filters", "column_migrations", "missing_schemas", "extensions", "open_options"):
            setattr(self, name, copy.copy(getattr(self, name)))

    def migrate(self, df: DataFrame) -> DataFrame:
        return df

    def file_migration(self, df: DataFrame, path: str, uri: str, layer: str | None) -> DataFrame:
        return df

    def layer_filter(self, layer: str | None, uri: str) -> bool:
        return True

    def post_migrate(self, df: DataFrame) -> DataFrame:
        return df

    def get_columns(self, df: DataFrame) -> Mapping[str, str | Sequence[str]]:
        return self.columns

    def collection(self) -> Collection:
        title = f"{self.title} ({self.variant})" if self.variant else self.title
        found = {"schemas": {self.id: sorted({CORE, *self.extensions})}, "title": title, "description": self.description.strip(), "license": self.license, "provider": self.provider, "attribution": self.attribution}
        out = Collection({k: v for k, v in found.items() if v})
        if self.missing_schemas:
            out["schemas:custom"] = copy.deepcopy(dict(self.missing_schemas))
        return out

    def convert(self, spark: SparkSession, inputs: Mapping[str, Any] | Sequence[str] | None = None, variant: str | None = None, cache: str | None = None, original_geometries: bool = False) -> FeatureTable:
        """The table, as a plan: scan, per-part hook, union, filter, additions, migrations, column map, geometry clean-up
        and Hilbert order. Only the order's bounds are computed here; writing runs the rest."""
        if self.bbox is not None and len(self.bbox) != 4:
            raise ValueError("bbox must have four numbers")
        if self.data_access and not inputs and not cache:
            raise PermissionError(self.data_access.strip())
        self.variant = variant or self.variant
        uris = inputs if isinstance(inputs, Mapping) else dict(map(_input, inputs)) if inputs else choose_sources(self.sources, self.variants, self.variant)
        parts = []
        for path, uri in download(uris, cache or shared_folder(spark)):
            for df, p, u, layer in read_layers(spark, path, uri, self.layer_filter, self.open_options):
                parts.append(self.file_migration(c.index_as_id(df) if self.index_as_id else df, p, u, layer))
        if not parts:
            raise ValueError("No layers left to convert")
        return self.plan(union(parts), original_geometries)

    def plan(self, df: DataFrame, original_geometries: bool = False) -> FeatureTable:
        """The steps after the scan."""
        df = self.migrate(df)
        mapping = dict(self.get_columns(df))
        df = c.filter_rows(df, self.column_filters)
        df = c.add_constants(df, self.column_additions, self.id)
        df = self.post_migrate(c.migrate_columns(df, self.column_migrations))
        for name in [*self.column_additions, "collection", *(["id"] if self.index_as_id else [])]:
            mapping.setdefault(name, name)
        df = c.map_columns(df, mapping)
        if "geometry" in df.columns:
            if not original_geometries:
                df = df.withColumn("geometry", g.drop_z(F.col("geometry")))
                df = keep_valid_polygons(g.explode_parts(fix_geometries(df)))
            df = g.hilbert_sort(df)
        return FeatureTable(df, self.collection(), self.crs)


def _input(value: str) -> tuple[str, Any]:
    uri, members = parse_input(value)
    return uri, members or Path(uri).name


class AdminConverter(Converter):
    """A converter that adds country and subdivision codes; the country is the start of the id."""

    admin_country_code: str | None = None
    admin_subdivision_code: str | None = None
    admin_schema: str = CORE.partition("/specification")[0] + "/administrative-division-extension/v0.1.0/schema.yaml"

    def __init__(self) -> None:
        super().__init__()
        codes = c.admin_columns(self.admin_country_code or self.id, self.admin_subdivision_code)
        self.column_additions = dict(self.column_additions) | codes
        self.extensions = [*self.extensions, self.admin_schema]


def discover(package: ModuleType | str) -> dict[str, type[Converter] | Exception]:
    """By module name the converter class that the module itself defines; a module that fails has its error instead."""
    package = importlib.import_module(package) if isinstance(package, str) else package
    out: dict[str, type[Converter] | Exception] = {}
    for m in pkgutil.iter_modules(package.__path__):
        if m.name.startswith(("_", "template")):
            continue
        try:
            out[m.name] = load(f"{package.__name__}.{m.name}")
        except Exception as e:  # a broken plug-in must not hide the others
            out[m.name] = e
    return out


def load(name: str) -> type[Converter]:
    """The converter class of a module, by its dotted name or its file."""
    if name.endswith(".py"):
        spec = importlib.util.spec_from_file_location(Path(name).stem, name)
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
    else:
        module = importlib.import_module(name)
    found = [x for x in vars(module).values() if isinstance(x, type) and issubclass(x, Converter) and x.__module__ == module.__name__]
    if not found:
        raise ValueError(f"{name} defines no converter")
    if len(found) > 1:
        warnings.warn(f"{name} defines several converters; the last is used", stacklevel=2)
    return found[-1]


def convert_file(spark: SparkSession, converter: Converter, target: str, compression: str | None = "zstd", level: int | None = None, version: str | None = None, single_file: bool = False, schema_map: Mapping[str, Any] | None = None, **options: Any) -> None:
    """Converts and writes GeoParquet."""
    write_geoparquet(converter.convert(spark, **options), target, compression=compression, level=level, version=version, single_file=single_file, schema_map=schema_map)
