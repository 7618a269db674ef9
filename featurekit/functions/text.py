"""Scalar helpers: ISO timestamps, links, file sizes, names of URIs, nested keys."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def iso8601(ts: Column) -> Column:
    """Text with a Z; the session's time zone is UTC. Fractions of a second appear where there are any."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.rtrim(F.date_format(ts, "SSSSSS"), F.lit("0"))
    return F.concat(whole, F.when(fraction == "", "").otherwise(F.concat(F.lit("."), fraction)), F.lit("Z"))


def to_iso8601(value: datetime) -> str:
    """The same for one value; a naive one counts as UTC, another offset is an error."""
    if value.utcoffset() not in (None, timedelta(0)):
        raise ValueError("Only UTC timestamps are supported")
    return value.replace(tzinfo=None).isoformat() + "Z"


LINK = r"^\s*(.*?)\s*<\s*([^<>]+?)\s*>\s*$"


def link_name(c: Column) -> Column:
    """The name of "Name <URL>", or all of a text without a URL."""
    return F.when(c.rlike(LINK), F.regexp_extract(c, LINK, 1)).otherwise(F.trim(c))


def link_url(c: Column) -> Column:
    return F.when(c.rlike(LINK), F.regexp_extract(c, LINK, 2))


def parse_link(text: str) -> tuple[str, str | None]:
    m = re.match(LINK, text)
    return (m[1], m[2]) if m else (text.strip(), None)


def format_filesize(size: float) -> str:
    for unit in ("B", "KB", "MB", "GB", "TB"):
        if size < 1024:
            return f"{size:.2f} {unit}"
        size /= 1024
    return f"{size:.2f} PB"


def is_url(text: object, schemes: tuple[str, ...] = ("http", "https", "s3", "gs")) -> bool:
    return isinstance(text, str) and bool(re.match(rf"({'|'.join(schemes)})://[^/]", text))


def name_from_uri(uri: str) -> str:
    return re.split(r"[?#]", str(uri))[0].rstrip("/").rpartition("/")[2]


def uri_name(c: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(F.regexp_extract(c, r"^[^?#]*", 0), "/+$", ""), "/"), -1)


def flat_columns(schema: StructType, delimiter: str = ".", path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], str]]:
    for f in schema.fields:
        at = (*path, f.name)
        if isinstance(f.dataType, StructType) and f.dataType.fields:
            yield from flat_columns(f.dataType, delimiter, at)
        else:
            yield at, delimiter.join(at)


def flatten_structs(df: DataFrame, keep: tuple[str, ...] = ("geometry", "bbox"), delimiter: str = ".") -> DataFrame:
    """A column for each leaf of nested structs, named by its path; ``keep`` stay whole."""
    kept = StructType([f for f in df.schema.fields if f.name not in keep])
    leaves = [F.col(".".join(f"`{p}`" for p in path)).alias(name) for path, name in flat_columns(kept, delimiter)]
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c in keep), *leaves)


def flatten(value: Mapping[str, Any], delimiter: str = ".", sequences: bool = False) -> dict[str, Any]:
    """Nested mappings as one, keys joined; an empty one keeps its key. With ``sequences``, items too, by their index."""
    out: dict[str, Any] = {}

    def walk(at: str, x: Any) -> None:
        inner = x.items() if isinstance(x, Mapping) else enumerate(x) if sequences and isinstance(x, (list, tuple)) else None
        if inner is None or not x:
            out[at] = x
            return
        for k, v in inner:
            walk(f"{at}{delimiter}{k}", v)

    for k, v in value.items():
        walk(str(k), v)
    return out


def nest(flat: Mapping[str, Any], delimiter: str = ".") -> dict[str, Any]:
    """The nested mapping of joined keys."""
    out: dict[str, Any] = {}
    for key, value in flat.items():
        *above, last = key.split(delimiter)
        at = out
        for part in above:
            if not isinstance(at.setdefault(part, {}), dict):
                raise TypeError(f"{key}: {part} is not a mapping")
            at = at[part]
        at[last] = value
    return out


class FlatDict(dict):
    """A nested mapping read, set and deleted by joined keys."""

    def __init__(self, value: Mapping[str, Any] | None = None, delimiter: str = ".", sequences: bool = False):
        self.delimiter = delimiter
        super().__init__(flatten(value or {}, delimiter, sequences))

    def _below(self, key: str) -> list[str]:
        return [k for k in self.keys() if k.startswith(key + self.delimiter)]

    def __contains__(self, key: object) -> bool:
        return super().__contains__(key) or bool(self._below(str(key)))

    def __getitem__(self, key: str) -> Any:
        if super().__contains__(key):
            return super().__getitem__(key)
        if below := self._below(key):
            return nest({k[len(key) + len(self.delimiter) :]: super(FlatDict, self).__getitem__(k) for k in below}, self.delimiter)
        raise KeyError(key)

    def __setitem__(self, key: str, value: Any) -> None:
        for k in self._below(key):
            super().__delitem__(k)
        for k, v in flatten({key: value}, self.delimiter).items():
            super().__setitem__(k, v)

    def __delitem__(self, key: str) -> None:
        found = [key] if super().__contains__(key) else self._below(key)
        if not found:
            raise KeyError(key)
        for k in found:
            super().__delitem__(k)

    def set_delimiter(self, delimiter: str) -> None:
        items = {k.replace(self.delimiter, delimiter): v for k, v in self.items()}
        self.clear()
        self.update(items)
        self.delimiter = delimiter

    def as_dict(self) -> dict[str, Any]:
        return nest(self, self.delimiter)
