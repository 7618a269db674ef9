"""Dataset-level metadata, its schemas, and the movement of constants between rows and metadata (X of the inventory)."""

from __future__ import annotations

import copy
import re
from collections.abc import Iterable, Mapping, Sequence
from typing import TYPE_CHECKING, Any

from featurekit.operators import columns as c
from featurekit.schema import algebra
from featurekit.schema.bundled import CORE, CORE_PATTERN

if TYPE_CHECKING:
    from featurekit.table import FeatureTable


def parse_schemas(uris: Iterable[str]) -> tuple[str | None, str | None, list[str]]:
    """Version and URI of the core schema, and the extensions in order."""
    uris = set(uris)
    core = next((u for u in sorted(uris) if CORE_PATTERN.fullmatch(u)), None)
    return CORE_PATTERN.fullmatch(core)[1] if core else None, core, sorted(uris - {core})


class Collection(dict):
    """Metadata of a dataset. ``schemas`` maps each collection's id to a list of schema URIs."""

    @property
    def schemas(self) -> dict[str, set[str]]:
        return {cid: set(uris) for cid, uris in (self.get("schemas") or {}).items()}

    @property
    def custom(self) -> dict[str, Any]:
        return copy.deepcopy(self.get("schemas:custom") or {})

    def merged_schema(self, schema_map: Mapping[str, Any] | None = None, cid: str | None = None) -> algebra.Schema:
        """All schemas of a collection (or of all) and the custom one, as one."""
        uris = set().union(*(u for k, u in self.schemas.items() if cid in (None, k)), set()) or {CORE}
        return algebra.merge_all([*algebra.resolve(uris, schema_map).values(), self.custom])

    def context(self, schema_map: Mapping[str, Any] | None = None) -> dict[str, bool]:
        """By property whether it may be in the metadata only (True) or in features only (False)."""
        return self.merged_schema(schema_map)["collection"]

    def only_here(self, schema_map: Mapping[str, Any] | None = None) -> set[str]:
        return {k for k, v in self.context(schema_map).items() if v} | {"schemas", "schemas:custom"}

    def add_schema(self, uri: str) -> Collection:
        return Collection(copy.deepcopy(dict(self)) | {"schemas": {cid: sorted(uris | {uri}) for cid, uris in self.schemas.items()}})

    def remove_schema(self, uri: str) -> Collection:
        return Collection(copy.deepcopy(dict(self)) | {"schemas": {cid: sorted(uris - {uri}) for cid, uris in self.schemas.items()}})

    def with_extension(self, path: str) -> Collection:
        """With an extension of the host that serves the core schema, for every collection."""
        out: dict[str, list[str]] = {}
        for cid, uris in self.schemas.items():
            host = re.match(r"https?://[^/]+", next((u for u in sorted(uris) if CORE_PATTERN.fullmatch(u)), CORE))[0]
            out[cid] = sorted(uris | {host + path})
        return Collection(copy.deepcopy(dict(self)) | ({"schemas": out} if out else {}))

    def renamed(self, mapping: Mapping[str, str]) -> Collection:
        out = Collection(copy.deepcopy(dict(self)))
        if out.get("schemas:custom"):
            custom = algebra.schema_of(out["schemas:custom"])
            out["schemas:custom"] = algebra.pick(custom, {*custom["properties"], *custom["required"], *custom["collection"]}, mapping)
        return out


def unique_schemas(collection: Collection) -> set[str]:
    return set().union(*collection.schemas.values(), set())


def hydrate(t: FeatureTable, schema_map: Mapping[str, Any] | None = None) -> FeatureTable:
    """Metadata that may stand in features as constant columns; columns that exist win. A single collection's id becomes
    the column ``collection``."""
    here = t.collection.only_here(schema_map)
    values = {k: v for k, v in t.collection.items() if k not in here}
    if "collection" not in values and len(t.collection.schemas) == 1:
        values["collection"] = next(iter(t.collection.schemas))
    new = {k: v for k, v in values.items() if k not in t.columns}
    rest = Collection({k: v for k, v in t.collection.items() if k in here})
    return t.with_(df=c.add_constants(t.df, new), collection=rest)


def dehydrate(t: FeatureTable, properties: Sequence[str] | None = None, schema_map: Mapping[str, Any] | None = None) -> FeatureTable:
    """Columns of one value in all rows (null counts as one) become metadata; ``collection`` also stays a column. Columns
    with a context of their own, nested ones and those not in ``properties`` stay, as do all of a table of one row."""
    fixed = t.collection.context(schema_map)
    names = [n for n in t.columns if n not in fixed and n != t.geometry and (properties is None or n in properties)]
    found = c.constants_of(t.df, names)
    moved = {k: c.jsonable(v) for k, v in found.items()}
    return t.with_(df=t.df.drop(*(k for k in found if k != "collection")), collection=Collection(dict(t.collection) | moved))


def merge_collections(collections: Sequence[Collection], properties: Sequence[str] | None = None) -> Collection:
    """Schema lists by collection id, of equal ids the last one's; custom schemas merged, of ``properties`` only. All
    other metadata stand in the rows by then."""
    out = Collection()
    schemas: dict[str, list[str]] = {}
    for x in collections:
        schemas |= {cid: sorted(uris) for cid, uris in x.schemas.items()}
    if schemas:
        out["schemas"] = schemas
    custom = algebra.merge_all(x.custom for x in collections)
    if properties is not None:
        custom = algebra.pick(custom, properties)
    if custom["properties"]:
        out["schemas:custom"] = custom
    return out
