"""Schemas that ship with the library. They are reconstructions from what is known of the published ones, which are remote;
a schema map from URI to local file replaces any of them."""

from __future__ import annotations

import copy
import json
import re
from functools import cache
from pathlib import Path
from typing import Any

import yaml

SDL = "https://schemas.example.org/sdl/v0.2.0/schema.json"
CORE = "https://schemas.example.org/specification/v0.1.0/schema.yaml"
#: Versions that are supported: of the specification and of the schema language.
SPECIFICATION, LANGUAGE = ">=0.1.0,<0.2.0", ">=0.2.0,<0.3.0"
#: How the URIs of core schemas and of the schema language end, on any host.
CORE_PATTERN = re.compile(r"https?://[^/]+/specification/v(\d+\.\d+\.\d+)/schema\.yaml")
SDL_PATTERN = re.compile(r"https?://[^/]+/sdl/v(\d+\.\d+\.\d+)/schema\.json")

_CORE: dict[str, Any] = {
    "$schema": SDL,
    "required": ["id", "geometry", "collection"],
    "collection": {"schemas": True, "schemas:custom": True, "id": False, "geometry": False, "bbox": False},
    "properties": {
        "schemas": {"type": "object", "additionalProperties": {"type": "array", "items": {"type": "string", "format": "uri"}}},
        "schemas:custom": {"type": "object", "additionalProperties": True},
        "id": {"type": "string", "minLength": 1},
        "collection": {"type": "string", "minLength": 1},
        "geometry": {"type": "geometry"},
        "bbox": {"type": "bounding-box"},
    },
}
_EXTENSIONS: dict[str, dict[str, Any]] = {
    r"/administrative-division-extension/v0\.1\.\d+/schema\.yaml$": {
        "$schema": SDL,
        "required": ["admin:country_code"],
        "properties": {"admin:country_code": {"type": "string", "minLength": 2, "maxLength": 2, "pattern": "^[A-Z]{2}$"}, "admin:subdivision_code": {"type": "string", "minLength": 1, "maxLength": 3, "pattern": "^[A-Z0-9]{1,3}$"}},
    },
    r"/inspire-extension/v0\.3\.\d+/schema\.yaml$": {"$schema": SDL, "required": ["inspire:id"], "properties": {"inspire:id": {"type": "string", "format": "uri"}}},
    r"/geometry-metrics-extension/v0\.1\.\d+/schema\.yaml$": {
        "$schema": SDL,
        "properties": {"metrics:area": {"type": "float", "exclusiveMinimum": 0}, "metrics:perimeter": {"type": "float", "exclusiveMinimum": 0}},
    },
}

#: JSON Schema of each data type in GeoJSON. Fixed values.
DATATYPES: dict[str, dict[str, Any]] = {
    "boolean": {"type": "boolean"},
    **{f"{u}int{b}": {"type": "integer", "minimum": 0 if u else -(2 ** (b - 1)), "maximum": 2**b - 1 if u else 2 ** (b - 1) - 1} for b in (8, 16, 32, 64) for u in ("", "u")},
    "float": {"type": "number"},
    "double": {"type": "number"},
    "binary": {"type": "string", "contentEncoding": "binary"},
    "string": {"type": "string"},
    "array": {"type": "array"},
    "object": {"type": "object"},
    "date": {"type": "string", "format": "date"},
    "date-time": {"type": "string", "format": "date-time", "pattern": "Z$"},
    "geometry": {"$ref": "https://geojson.org/schema/Geometry.json"},
    "bounding-box": {"type": "array", "minItems": 4, "maxItems": 4, "items": {"type": "number"}},
}


@cache
def _document(uri: str) -> Any:
    text = Path(uri).read_text(encoding="utf-8")
    return json.loads(text) if uri.lower().endswith((".json", ".geojson")) else yaml.safe_load(text)


def load_file(uri: str | Path) -> Any:
    """A JSON or YAML document, by its suffix; each caller gets a copy of its own."""
    return copy.deepcopy(_document(str(uri)))


def load_schema(uri: str, schema_map: dict[str, Any] | None = None) -> dict[str, Any]:
    """The schema of a URI: from the map, from the bundle, or from a local file. Nothing is fetched."""
    if schema_map and uri in schema_map:
        found = schema_map[uri]
        return copy.deepcopy(found) if isinstance(found, dict) else load_file(found)
    if CORE_PATTERN.fullmatch(uri):
        return copy.deepcopy(_CORE)
    for pattern, schema in _EXTENSIONS.items():
        if re.search(pattern, uri):
            return copy.deepcopy(schema)
    if Path(uri).exists():
        return load_file(uri)
    raise FileNotFoundError(f"Schema {uri} is not available; add it to the schema map")


def parse_schema_map(values: list[str]) -> dict[str, str]:
    """Pairs "URL,path" as a mapping; the path must exist."""
    out = {}
    for value in values:
        url, _, path = value.partition(",")
        if not re.match(r"(https?|s3|gs)://", url) or not Path(path).exists():
            raise ValueError(f"Invalid schema mapping: {value}")
        out[url] = path
    return out


def version_matches(version: str, wanted: str) -> bool:
    """Whether a semantic version lies in a range such as ">=0.1.0,<0.2.0"."""
    parse = lambda v: tuple(map(int, v.split("-")[0].split(".")))
    if not re.fullmatch(r"\d+\.\d+\.\d+(-.*)?", version):
        return False
    tests = {">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, "<": lambda a, b: a < b, "==": lambda a, b: a == b}
    for part in wanted.split(","):
        op = re.match(r"\s*(>=|<=|==|>|<)", part)
        if not tests[op[1] if op else "=="](parse(version), parse(part.strip().lstrip("<>="))):
            return False
    return True
