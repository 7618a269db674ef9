"""Splittable scan of GeoJSON documents: one file of any size is cut into byte ranges that tasks read side by side.

Whether a cut lies within a string, and how deep, cannot be told from what is near it. So each range is first summed up
for both cases (quotes, change of depth, least depth); one small row a range comes to the driver, where the cases settle
from the file's start on. A range then knows its state and gives the elements of the features array that begin in it,
reading on into the next range for the last one. Tasks hold a few megabytes at a time; the driver holds what stands outside
the features."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from featurekit.sources.geoparquet import filesystem

#: Bytes of a range, of one read within it, and of the end of a file that a scan of first features looks at.
RANGE, CHUNK, TAIL = 32 << 20, 4 << 20, 8 << 20
_BATCH = 1 << 22  # bytes of features in one Arrow batch
_QUOTE, _OPEN, _CLOSE, _COMMA, _ESCAPE = 1, 2, 3, 4, 92
_CLASS = np.zeros(256, np.uint8)
_CLASS[[ord('"')]] = _QUOTE
_CLASS[[ord("{"), ord("[")]] = _OPEN
_CLASS[[ord("}"), ord("]")]] = _CLOSE
_CLASS[ord(",")] = _COMMA


@dataclass(frozen=True)
class Marks:
    """Quotes that are not escaped, brackets and commas of some bytes, without regard to strings."""

    at: np.ndarray
    kind: np.ndarray
    quotes: np.ndarray  # how many quotes stand before each mark

    @classmethod
    def of(cls, data: np.ndarray) -> Marks:
        at = np.flatnonzero(_CLASS[data])
        kind = _CLASS[data[at]]
        back = np.flatnonzero(data == _ESCAPE)
        if len(back):
            last = np.append(np.diff(back) != 1, True)
            first = np.append(True, np.diff(back) != 1)
            escaped = back[last][(back[last] - back[first]) % 2 == 0] + 1
            keep = (kind != _QUOTE) | ~np.isin(at, escaped)
            at, kind = at[keep], kind[keep]
        quote = kind == _QUOTE
        return cls(at, kind, np.cumsum(quote) - quote)

    def total_quotes(self) -> int:
        return int(self.quotes[-1] + (self.kind[-1] == _QUOTE)) if len(self.at) else 0

    def structure(self, inside: bool, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places and kinds of brackets and commas outside strings, and the depth after each."""
        out = ((self.quotes + inside) % 2 == 0) & (self.kind != _QUOTE)
        kind = self.kind[out]
        step = (kind == _OPEN).astype(np.int64) - (kind == _CLOSE)
        return self.at[out], kind, depth + np.cumsum(step)


def _read(f: Any, at: int, size: int) -> bytes:
    f.seek(at)
    return f.read(size)


def aligned(f: Any, at: int, size: int) -> int:
    """The first place from ``at`` on that no backslash stands before, so that no escape is cut."""
    while 0 < at < size:
        run = _read(f, at - 1, 64)
        if (n := len(run) - len(run.lstrip(b"\\"))) < len(run):
            return at + n
        at += n
    return min(at, size)


def chunks(f: Any, start: int, end: int, size: int = CHUNK) -> Iterator[tuple[int, np.ndarray]]:
    """The bytes from ``start`` to ``end`` in pieces that cut no escape, with their places."""
    rest, at = b"", start
    while at < end:
        data = rest + _read(f, at, min(size, end - at))
        at += len(data) - len(rest)
        keep = len(data) if at >= end else len(data.rstrip(b"\\"))
        rest = data[keep:]
        yield at - len(data), np.frombuffer(data[:keep], np.uint8)


def summed_up(f: Any, start: int, end: int) -> tuple[int, list[tuple[int, int]]]:
    """Parity of quotes, and for a start outside and within a string: change of depth and least depth on the way."""
    parity, cases = 0, [(0, 0), (0, 0)]
    for _, data in chunks(f, start, end):
        marks = Marks.of(data)
        for case in (0, 1):
            change, least = cases[case]
            depth = marks.structure(bool(case ^ parity), change)[2]
            if len(depth):
                cases[case] = int(depth[-1]), min(least, int(depth.min()))
        parity ^= marks.total_quotes() % 2
    return parity, cases


@dataclass(frozen=True)
class Range:
    start: int
    end: int
    inside: bool
    depth: int
    least: int


@dataclass(frozen=True)
class Layout:
    """A document's members outside the features, where the features array opens and closes, and its ranges."""

    path: str
    members: dict[str, Any]
    opens: int = -1
    closes: int = -1
    ranges: list[Range] = field(default_factory=list)

    @property
    def kind(self) -> Any:
        return self.members.get("type")


def _outline(f: Any, path: str, size: int, spans: list[tuple[int, int]], ranges: list[Range]) -> Layout:
    """The document's members, from what stands outside the spans of depth two (and within them, but for the features)."""
    text, at = b"", 0
    for k, (a, b) in enumerate(spans):
        text += _read(f, at, a - at) + b'{"span":%d}' % k
        at = b + 1
    text += _read(f, at, size - at)
    try:
        found = json.loads(text.decode("utf-8-sig"))
    except ValueError as e:
        raise ValueError(f"{path} is no JSON document: {e}") from None
    if not isinstance(found, dict) or found.get("type") not in ("FeatureCollection", "Feature"):
        raise ValueError("Only Feature and FeatureCollection are supported")
    opens = closes = -1
    members = {}
    for name, value in found.items():
        span = spans[value["span"]] if isinstance(value, dict) else None
        if name == "features" and found["type"] == "FeatureCollection":
            if span is None or _read(f, span[0], 1) != b"[":
                raise ValueError("features must be an array")
            opens, closes = span
        elif span is None:
            members[name] = value
        elif name not in ("geometry", "properties"):
            members[name] = json.loads(_read(f, span[0], span[1] + 1 - span[0]))
    return Layout(path, members, opens, closes, ranges)


def _spans(path: str, events: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Opening and closing places of depth two, of events (place, kind, depth after)."""
    events = sorted(events)
    if [d for _, k, d in events if k == _CLOSE and d < 1] != [0] or events[0][1:] != (_OPEN, 1):
        raise ValueError(f"{path} is no JSON document")
    opens = [p for p, k, d in events if k == _OPEN and d == 2]
    return list(zip(opens, (p for p, k, d in events if k == _CLOSE and d == 1), strict=True))


def _top_events(f: Any, r: Range) -> Iterator[tuple[int, int, int]]:
    inside, depth = r.inside, r.depth
    for at, data in chunks(f, r.start, r.end):
        marks = Marks.of(data)
        where, kind, after = marks.structure(inside, depth)
        top = ((kind == _OPEN) & (after <= 2)) | ((kind == _CLOSE) & (after <= 1))
        yield from zip((where[top] + at).tolist(), kind[top].tolist(), after[top].tolist(), strict=True)
        inside, depth = inside ^ bool(marks.total_quotes() % 2), int(after[-1]) if len(after) else depth


def _side_by_side(spark: SparkSession, n: int, make, schema: str) -> DataFrame:
    """What ``make`` gives for each of n numbers, each in a task of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                yield from make(k)

    return spark.range(0, n, 1, max(n, 1)).mapInArrow(run, schema)


def _numbers(spark: SparkSession, n: int, make, width: int) -> list[tuple[int, ...]]:
    """Rows of numbers that ``make`` gives for each of n ranges; a file of one range needs no task for it."""
    if n == 1:
        return [tuple(r) for r in make(0)]
    names = [f"v{i}" for i in range(width)]

    def batch(k: int) -> Iterator[pa.RecordBatch]:
        rows = make(k)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(width)], names)

    return [tuple(r) for r in _side_by_side(spark, n, batch, ", ".join(f"{c} bigint" for c in names)).collect()]


def layout(spark: SparkSession, path: str, size: int = RANGE) -> Layout:
    """The layout of a document, read in full by ranges of ``size`` bytes, one task each."""
    fs, root = filesystem(path)
    total = fs.get_file_info(root).size
    if total is None:
        raise FileNotFoundError(path)
    n = max(-(-total // size), 1)

    def sums(k: int) -> tuple[int, ...]:
        with _opened(path) as f:
            start, end = aligned(f, k * size, total), aligned(f, (k + 1) * size, total)
            parity, ((c0, m0), (c1, m1)) = summed_up(f, start, end)
        return start, end, parity, c0, m0, c1, m1

    ranges, inside, depth = [], False, 0
    for start, end, parity, *cases in sorted(_numbers(spark, n, lambda k: [sums(k)], 7)):
        change, least = cases[2:] if inside else cases[:2]
        ranges.append(Range(start, end, inside, depth, depth + least))
        inside, depth = inside ^ bool(parity), depth + change
    if inside or depth:
        raise ValueError(f"{path} is no JSON document: it ends within a {'string' if inside else 'bracket'}")
    top = [r for r in ranges if r.least <= 1]

    def events(k: int) -> list[tuple[int, ...]]:
        with _opened(path) as f:
            return list(_top_events(f, top[k]))

    found = _numbers(spark, len(top), events, 3)
    with _opened(path) as f:
        return _outline(f, path, total, _spans(path, found) if found else [], ranges)


def _opened(path: str):
    fs, root = filesystem(path)
    return fs.open_input_file(root)


def head(path: str) -> Layout | None:
    """The layout by a file's beginning and its last ``TAIL`` bytes, for a scan of the first features; None where these do
    not tell. A member of more than ``TAIL`` bytes behind the features would be taken for a part of them."""
    fs, root = filesystem(path)
    with _opened(path) as f:
        size = f.size()
        inside, depth, events = False, 0, []
        opens = -1
        for at, data in chunks(f, 0, size, 1 << 18):
            marks = Marks.of(data)
            where, kind, after = marks.structure(inside, depth)
            for p, k, d in zip((where + at)[after <= 2].tolist(), kind[after <= 2].tolist(), after[after <= 2].tolist(), strict=True):
                if k == _OPEN and d == 2 and re.search(rb'(?<!\\)"features"\s*:\s*\[$', _read(f, max(p - 255, 0), min(p, 255) + 1)):
                    opens = p
                    break
                if k != _COMMA and (k == _OPEN or d <= 1):
                    events.append((p, k, d))
            if opens >= 0:
                break
            inside, depth = inside ^ bool(marks.total_quotes() % 2), int(after[-1]) if len(after) else depth
        if opens < 0:
            return None
        start = aligned(f, max(opens + 1, size - TAIL), size)
        marks = Marks.of(np.frombuffer(_read(f, start, size - start), np.uint8))
        where, kind, after = marks.structure(marks.total_quotes() % 2 == 1, 0)
        after = after - (after[-1] if len(after) else 0)
        closes = where[(kind == _CLOSE) & (after == 1)] + start
        late = where[(kind == _OPEN) & (after == 2)] + start
        if len(closes) != len(late) + 1:
            return None
        spans = [*zip((p for p, k, d in events if k == _OPEN and d == 2), (p for p, k, d in events if k == _CLOSE and d == 1), strict=True), (opens, int(closes[0]))]
        spans += list(zip(late.tolist(), closes[1:].tolist(), strict=True))
        try:
            return _outline(f, path, size, spans, [])
        except ValueError:
            return None


def elements(f: Any, r: Range, opens: int, closes: int) -> Iterator[bytes]:
    """The features array's elements whose beginning lies in a range; the last may end beyond it."""
    inside, depth, kept, since = r.inside, r.depth, b"", -1
    for at, data in chunks(f, r.start, closes + 1):
        if since < 0 and at >= r.end:
            return
        marks = Marks.of(data)
        where, kind, after = marks.structure(inside, depth)
        where = where + at
        cut = where[((kind == _COMMA) & (after == 2) & (where > opens) & (where < closes)) | (where == opens) | (where == closes)]
        text = data.tobytes()
        for p in cut.tolist():
            if since >= 0:
                if one := (kept + text[max(since + 1 - at, 0) : p - at]).strip():
                    yield one
                kept = b""
            since = p
            if p >= r.end or p == closes:
                return
        if since >= 0:
            kept += text[max(since + 1 - at, 0) :]
        inside, depth = inside ^ bool(marks.total_quotes() % 2), int(after[-1]) if len(after) else depth


def _batches(found: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    held: list[bytes] = []
    size = 0
    for one in found:
        held.append(one)
        size += len(one)
        if size >= _BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["value"])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["value"])


def scan(spark: SparkSession, found: Layout) -> DataFrame:
    """JSON text of every feature, in the file's order within each task; ranges without features have no task."""
    if found.kind == "Feature":
        return spark.read.text(found.path, wholetext=True)
    path, opens, closes = found.path, found.opens, found.closes
    ranges = [r for r in found.ranges if r.start <= closes and r.end > opens] if opens >= 0 else []

    def make(k: int) -> Iterator[pa.RecordBatch]:
        with _opened(path) as f:
            yield from _batches(elements(f, ranges[k], opens, closes))

    return _side_by_side(spark, len(ranges), make, "value string")


def scan_first(spark: SparkSession, found: Layout, num: int) -> DataFrame:
    """JSON text of the first ``num`` features, by one task that stops where they end."""
    if found.kind == "Feature":
        return spark.read.text(found.path, wholetext=True).limit(num)
    path, opens, closes = found.path, found.opens, found.closes

    def make(_: int) -> Iterator[pa.RecordBatch]:
        with _opened(path) as f:
            rest = elements(f, Range(opens, closes + 1, False, 1, 1), opens, closes)
            yield from _batches(islice(rest, num))

    return _side_by_side(spark, int(num > 0 and opens >= 0), make, "value string")
