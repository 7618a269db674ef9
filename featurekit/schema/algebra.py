"""Operations on schemas (M of the inventory). Plain mappings in, new mappings out; no rows are touched."""

from __future__ import annotations

import copy
from collections.abc import Iterable, Mapping
from typing import Any

from featurekit.schema.bundled import LANGUAGE, SDL, SDL_PATTERN, load_schema, version_matches

Schema = dict[str, Any]
_LOWER = ("minimum", "exclusiveMinimum", "minLength", "minItems", "minProperties")
_UPPER = ("maximum", "exclusiveMaximum", "maxLength", "maxItems", "maxProperties")
_MET = ("enum", "geometryTypes")
_ANY = ("deprecated", "uniqueItems")


def schema_of(value: Mapping[str, Any] | None) -> Schema:
    """A complete schema; a non-empty one must be of a supported version of the schema language."""
    value = copy.deepcopy(dict(value or {}))
    uri = value.get("$schema")
    if uri is not None:
        m = SDL_PATTERN.fullmatch(uri)
        if not m or not version_matches(m[1], LANGUAGE):
            raise ValueError(f"Unsupported schema version: {uri}")
    return {"$schema": uri or SDL, "required": list(value.get("required", [])), "collection": dict(value.get("collection", {})), "properties": dict(value.get("properties", {}))} if value else empty()


def empty() -> Schema:
    return {"$schema": SDL, "required": [], "collection": {}, "properties": {}}


def merge_keyword(key: str, a: Any, b: Any, strict: bool = False) -> Any:
    """What holds where both hold: sets meet, bounds narrow, flags add up, schemas merge; others must be equal. With
    ``strict`` every differing keyword is an error."""
    if a == b:
        return copy.deepcopy(a)
    if not strict:
        if key in _MET:
            met = [x for x in a if x in b]
            if not met:
                raise ValueError(f"Nothing satisfies both values of '{key}'")
            return met
        if key in _LOWER:
            return max(a, b)
        if key in _UPPER:
            return min(a, b)
        if key in _ANY:
            return bool(a or b)
        if key == "required":
            return list(dict.fromkeys([*a, *b]))
        if key in ("items", "contains", "additionalProperties") and isinstance(a, Mapping) and isinstance(b, Mapping):
            return merge_property(a, b)
        if key == "additionalProperties":
            return next((copy.deepcopy(x) for x in (a, b) if x is not True), True)
        if key in ("properties", "patternProperties"):
            return merge_properties(a, b)
    raise ValueError(f"Conflicting values of '{key}': {a!r} and {b!r}")


def merge_property(a: Mapping[str, Any], b: Mapping[str, Any], strict: bool = False) -> Schema:
    return {k: merge_keyword(k, a[k], b[k], strict) if k in a and k in b else copy.deepcopy(a.get(k, b.get(k))) for k in dict.fromkeys([*a, *b])}


def merge_properties(a: Mapping[str, Any], b: Mapping[str, Any], strict: bool = False) -> Schema:
    return {k: merge_property(a[k], b[k], strict) if k in a and k in b else copy.deepcopy(a.get(k, b.get(k))) for k in dict.fromkeys([*a, *b])}


def merge(a: Mapping[str, Any], b: Mapping[str, Any], strict: bool = False) -> Schema:
    """Union of what is required, of contexts (that must agree) and of properties."""
    a, b = schema_of(a), schema_of(b)
    version = lambda s: SDL_PATTERN.fullmatch(s["$schema"])[1]
    if version(a) != version(b):
        raise ValueError("Schemas of different versions can't be merged")
    for k in set(a["collection"]) & set(b["collection"]):
        if a["collection"][k] != b["collection"][k]:
            raise ValueError(f"Conflicting collection context of '{k}'")
    return {"$schema": a["$schema"], "required": sorted({*a["required"], *b["required"]}), "collection": a["collection"] | b["collection"], "properties": merge_properties(a["properties"], b["properties"], strict)}


def merge_all(schemas: Iterable[Mapping[str, Any]], strict: bool = False) -> Schema:
    out = empty()
    for s in schemas:
        if s:
            out = merge(out, s, strict) if out["properties"] or out["required"] or out["collection"] else schema_of(s)
    return out


def pick(schema: Mapping[str, Any], names: Iterable[str], rename: Mapping[str, str] | None = None) -> Schema:
    """The schema of the named properties only, under their new names."""
    names, to = set(names), lambda n: (rename or {}).get(n, n)
    s = schema_of(schema)
    return {"$schema": s["$schema"], "required": [to(n) for n in s["required"] if n in names], "collection": {to(n): v for n, v in s["collection"].items() if n in names}, "properties": {to(n): v for n, v in s["properties"].items() if n in names}}


def resolve(uris: Iterable[str], schema_map: Mapping[str, Any] | None = None) -> dict[str, Schema]:
    """The schema of every URI; a missing one raises."""
    return {u: schema_of(load_schema(u, dict(schema_map or {}))) for u in sorted(uris)}


def conflicts(a: Mapping[str, Any], b: Mapping[str, Any]) -> list[str]:
    """Keys on which both have different values."""
    return sorted(k for k in set(a) & set(b) if a[k] != b[k])
