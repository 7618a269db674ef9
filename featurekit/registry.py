"""What a deployment may change (H7, H8 of the inventory): encodings by suffix, required schemas, the converters' package."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from featurekit.operators.columns import CORE
from featurekit.plans import validate
from featurekit.sources import geojson, geoparquet
from featurekit.table import FeatureTable


@dataclass(frozen=True)
class Encoding:
    """How files of a format are read, written and validated."""

    name: str
    suffixes: tuple[str, ...]
    read: Callable[..., FeatureTable]
    write: Callable[..., None]
    validate: Callable[..., validate.Result]
    columnar: bool = False


def _write_parquet(t: FeatureTable, path: str, **options) -> None:
    geoparquet.write_geoparquet(t, path, single_file=True, **options)


def _write_json(t: FeatureTable, path: str, **options) -> None:
    geojson.write_geojson(t, path, **{k: v for k, v in options.items() if k in ("properties", "schema_map", "shrink", "indent")})


@dataclass
class Registry:
    """Subclass or change an instance to add encodings and to require schemas."""

    name: str = "featurekit"
    version: str = "0.1.0"
    core_properties: tuple[str, ...] = CORE
    required_schemas: list[str | re.Pattern] = field(default_factory=list)
    converters: str = "featurekit.datasets"
    encodings: list[Encoding] = field(
        default_factory=lambda: [
            Encoding("GeoJSON", (".json", ".geojson"), geojson.read_geojson, _write_json, validate.validate_geojson),
            Encoding("GeoParquet", (".parquet", ".geoparquet"), geoparquet.read_geoparquet, _write_parquet, validate.validate_parquet, True),
        ]
    )

    def register(self, encoding: Encoding) -> None:
        """Adds an encoding; for suffixes that others have too, it wins."""
        self.encodings.insert(0, encoding)

    def encoding(self, path: str | Path) -> Encoding:
        suffix = Path(str(path)).suffix
        found = next((e for e in self.encodings if suffix in e.suffixes), None)
        if found is None:
            raise ValueError(f"Unsupported file format: {path}")
        return found


REGISTRY = Registry()
