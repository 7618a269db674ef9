"""STAC Collection documents of a table (C6 and M12 of the inventory)."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurekit.functions import crs as crs_
from featurekit.functions import geometry as g
from featurekit.functions.text import iso8601, parse_link, to_iso8601
from featurekit.operators.columns import ref
from featurekit.table import FeatureTable

#: Addresses of extensions and licences. Fixed values.
PROCESSING = "https://stac-extensions.github.io/processing/v1.2.0/schema.json"
TABLE = "https://stac-extensions.github.io/table/v1.2.0/schema.json"
LICENSES = {
    "dl-de/by-2-0": ("https://www.govdata.de/dl-de/by-2-0", "Data licence Germany - attribution - Version 2.0"),
    "dl-de/zero-2-0": ("https://www.govdata.de/dl-de/zero-2-0", "Data licence Germany - Zero - Version 2.0"),
}
SOFTWARE = ("featurekit", "0.1.0")


def temporal_extent(df: DataFrame, column: str) -> DataFrame:
    """One row: the earliest and the latest time as ISO text."""
    ts = ref(column).cast("timestamp")
    return df.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi")).select(iso8601(F.col("lo")).alias("start"), iso8601(F.col("hi")).alias("end"))


def _word(meta: Mapping[str, Any], key: str) -> str:
    return str(meta.get(key) or "").strip()


def _time(value: str) -> str:
    return to_iso8601(datetime.fromisoformat(value.replace("Z", "+00:00")))


def _license(meta: Mapping[str, Any]) -> dict[str, Any]:
    """A known licence or an address becomes a link; a name alone is named."""
    text = _word(meta, "license")
    name, url = parse_link(text)
    known = LICENSES.get(text.lower())
    if known:
        return {"license": "other", "links": [{"rel": "license", "href": known[0], "title": known[1], "type": "text/html"}]}
    return {"license": "other", "links": [{"rel": "license", "href": url, "title": name}]} if url else {"license": name or "other", "links": []}


def _providers(meta: Mapping[str, Any]) -> dict[str, Any]:
    name, url = parse_link(_word(meta, "provider"))
    return {"providers": [{"name": name, "roles": ["producer", "licensor"], **({"url": url} if url else {})}]} if name or url else {}


def _interval(t: FeatureTable, temporal: str | None) -> list[str | None]:
    """The earliest and latest time of a column, or the one time that the metadata state."""
    if temporal in t.columns:
        return list(temporal_extent(t.df, temporal).first())
    return [_time(t.collection[temporal])] * 2 if temporal and t.collection.get(temporal) else [None, None]


def _columns(t: FeatureTable, columns: Mapping[str, list[str]]) -> dict[str, Any]:
    described = [{"name": n, "type": next(x for x in kinds if x != "null")} for n, kinds in columns.items()]
    return {"table:columns": described, "table:primary_geometry": t.geometry, "table:row_count": t.df.count()}


def collection_document(t: FeatureTable, href: str, media_type: str | None = None, temporal: str | None = None, columns: dict[str, list[str]] | None = None) -> dict[str, Any]:
    """The document. All that the table lacks for one is said in one error: one collection, its id, a description, rows
    with a geometry. One aggregate finds the box (which is reprojected by its corners), one the times; ``columns`` of a
    columnar file add the table extension."""
    meta, several = t.collection, len(t.collection.schemas) > 1
    name, about = meta.get("collection") or next(iter(meta.schemas), None), _word(meta, "description")
    lacking = [what for what, there in (("exactly one collection", not several), ("a collection id", name), ("a description", about)) if not there]
    corners = None if lacking else g.total_bounds(t.df, t.geometry).first()
    if not lacking and (corners is None or corners["xmin"] is None):
        lacking = ["rows with a geometry"]
    if lacking:
        raise ValueError(f"No STAC collection without {' and '.join(lacking)}")
    box = crs_.reproject_box(tuple(corners), t.crs or 4326, 4326)
    asset = {"href": href, "roles": ["data"], "processing:software": dict([SOFTWARE]), **({"type": media_type} if media_type else {})}
    tabular = {} if columns is None else _columns(t, columns)
    return {
        "type": "Collection",
        "stac_version": "1.1.0",
        "stac_extensions": [PROCESSING, *([TABLE] if tabular else [])],
        "id": name,
        "title": meta.get("title") or name,
        "description": about,
        "extent": {"spatial": {"bbox": [list(box)]}, "temporal": {"interval": [_interval(t, temporal)]}},
        "assets": {"data": asset | tabular},
        **_license(meta),
        **_providers(meta),
    }
