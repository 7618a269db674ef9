"""Inputs written by the tests themselves."""

import json
from pathlib import Path

HOST = "https://schemas.example.org"
CORE = f"{HOST}/specification/v0.1.0/schema.yaml"
ADMIN = f"{HOST}/administrative-division-extension/v0.1.0/schema.yaml"
INSPIRE = f"{HOST}/inspire-extension/v0.3.0/schema.yaml"


def square(x: float, y: float, s: float = 0.25) -> dict:
    return {"type": "Polygon", "coordinates": [[[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]]}


def feature(number: str, at: tuple[float, float], **props) -> dict:
    return {"type": "Feature", "id": number, "geometry": square(*at), "properties": props}


def admin(**props) -> dict:
    """A lake, with codes of administrative division and a column that no schema knows."""
    own = {"collection": "lakes", "admin:country_code": "FI", "admin:subdivision_code": "KS", "depth_class": "deep"}
    return feature("lake-7", (27, 62), **own | props) | {"schemas": {"lakes": [CORE, ADMIN]}}


def inspire(number: str = "1", **props) -> dict:
    """A mire with an address as its id, and a time that a schema of its own describes."""
    own = {"collection": "mires", "inspire:id": f"https://id.example.org/mire/{number}", "surveyed": "2021-06-15T12:00:00Z"}
    custom = {"properties": {"surveyed": {"type": "date-time"}}}
    return feature(number, (24, 65), **own | props) | {"schemas": {"mires": [CORE, INSPIRE]}, "schemas:custom": custom}


def mixed(**props) -> dict:
    """Both in one FeatureCollection."""
    both = [admin(**props), inspire()]
    features = [{k: f[k] for k in ("type", "id", "geometry", "properties")} for f in both]
    return {"type": "FeatureCollection", "features": features, "schemas": both[0]["schemas"] | both[1]["schemas"], "schemas:custom": both[1]["schemas:custom"]}


def put(folder: Path, name: str, value: dict) -> str:
    path = folder / name
    path.write_text(json.dumps(value))
    return str(path)
