"""WKB to and from native geometries, by Arrow-batched functions."""

from __future__ import annotations

import struct
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BinaryType

from featurekit.functions.geometry import TYPE

#: Numbers of the geometry types. Fixed values of the format.
CODES = {"Point": 1, "LineString": 2, "Polygon": 3, "MultiPoint": 4, "MultiLineString": 5, "MultiPolygon": 6}
NAMES = {v: k for k, v in CODES.items()}
#: The Arrow type of a native geometry.
ARROW = pa.struct([("type", pa.string()), ("parts", pa.list_(pa.list_(pa.list_(pa.list_(pa.float64())))))])


def encode(kind: str, parts: list) -> bytes:
    """Little-endian ISO WKB; three coordinates give the Z types. A point without coordinates is NaN."""
    parts = [[[np.asarray(p, float) for p in r] for r in part] for part in parts]
    z = any(len(p) > 2 for part in parts for r in part for p in r)
    head = lambda k: struct.pack("<BI", 1, CODES[k] + 1000 * z)
    dims = 3 if z else 2
    line = lambda r: struct.pack("<I", len(r)) + b"".join(np.resize(p, dims).astype("<f8").tobytes() if len(p) != dims else p.astype("<f8").tobytes() for p in r)

    def one(k: str, part: list) -> bytes:
        if k == "Point":
            return head(k) + (np.asarray(part[0][0], "<f8")[:dims].tobytes() if part and part[0] else np.full(dims, np.nan).tobytes())
        if k == "LineString":
            return head(k) + line(part[0] if part else [])
        return head(k) + struct.pack("<I", len(part)) + b"".join(map(line, part))

    if kind.startswith("Multi"):
        return head(kind) + struct.pack("<I", len(parts)) + b"".join(one(kind[5:], p) for p in parts)
    return one(kind, parts[0] if parts else [])


def decode(raw: bytes) -> tuple[str, list]:
    """Type and parts; both byte orders, ISO and EWKB flags for Z, M and SRID. M is dropped."""
    at = 0

    def take(fmt: str, n: int):
        nonlocal at
        out = struct.unpack_from(fmt, raw, at)
        at += n
        return out

    def line(order: str, dims: int) -> np.ndarray:
        nonlocal at
        (n,) = take(order + "I", 4)
        out = np.frombuffer(raw, order + "f8", n * dims, at).reshape(n, dims)
        at += 8 * n * dims
        return out

    def one() -> tuple[str, list]:
        order = "<" if take("B", 1)[0] else ">"
        (code,) = take(order + "I", 4)
        if code & 0x20000000:
            take(order + "I", 4)
        extra = code & 0xFFFF
        z, m = bool(code & 0x80000000) or extra // 1000 in (1, 3), bool(code & 0x40000000) or extra // 1000 in (2, 3)
        kind, dims, keep = NAMES.get(extra % 1000), 2 + z + m, 2 + z
        if kind is None:
            raise ValueError(f"Geometry type {extra % 1000} of WKB is not supported")
        if kind == "Point":
            p = list(take(f"{order}{dims}d", 8 * dims))[:keep]
            return kind, [] if np.isnan(p[0]) else [[[p]]]
        if kind == "LineString":
            return kind, [[line(order, dims)[:, :keep].tolist()]]
        if kind == "Polygon":
            return kind, [[line(order, dims)[:, :keep].tolist() for _ in range(take(order + "I", 4)[0])]]
        return kind, [part for _ in range(take(order + "I", 4)[0]) for part in one()[1]]

    return one()


#: Bits of the type's number that say what follows. Fixed values of the format.
_SRID, _Z, _M = 0x20000000, 0x80000000, 0x40000000


class _Bytes:
    """The bytes of many WKB values, read at one place of each at a time."""

    def __init__(self, raw: pa.Array):
        wide = np.int64 if pa.types.is_large_binary(raw.type) else np.int32
        _, offsets, data = raw.buffers()
        self.starts = np.frombuffer(offsets, wide)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64) if len(raw) else np.zeros(1, np.int64)
        self.data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)

    def check(self, row: np.ndarray, upto: np.ndarray) -> None:
        if len(row) and (upto > self.starts[row + 1]).any():
            raise ValueError("A WKB value ends too early")

    def number(self, row: np.ndarray, at: np.ndarray, little: np.ndarray) -> np.ndarray:
        self.check(row, at + 4)
        four = self.data[at[:, None] + np.arange(4)]
        return np.where(little, four.view("<u4").ravel(), four.view(">u4").ravel()).astype(np.int64)

    def head(self, row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """Where the body begins, byte order, kind, and how many coordinates there are and stay; M is dropped."""
        self.check(row, at + 5)
        little = self.data[at] == 1
        code = self.number(row, at + 1, little)
        thousands = (code & 0xFFFF) // 1000
        z = ((code & _Z) != 0) | np.isin(thousands, (1, 3))
        m = ((code & _M) != 0) | np.isin(thousands, (2, 3))
        kind = (code & 0xFFFF) % 1000
        if len(row) and not np.isin(kind, list(NAMES)).all():
            raise ValueError(f"Geometry type {kind[~np.isin(kind, list(NAMES))][0]} of WKB is not supported")
        return at + 5 + 4 * ((code & _SRID) != 0), little, kind, 2 + z + m, 2 + z


class _Found:
    """Parts and rings as they are met: numbers of the row, part and ring, and where the ring's coordinates lie."""

    def __init__(self) -> None:
        self.parts: list[np.ndarray] = []
        self.rings: list[np.ndarray] = []

    def part(self, *columns) -> None:
        self.parts.append(np.stack(np.broadcast_arrays(*columns), 1))

    def ring(self, *columns) -> None:
        self.rings.append(np.stack(np.broadcast_arrays(*columns), 1))

    @staticmethod
    def sorted(tables: list[np.ndarray], keys: int, width: int) -> np.ndarray:
        found = np.concatenate([np.empty((0, width), np.int64), *tables])
        return found[np.lexsort(tuple(found[:, k] for k in reversed(range(keys))))]


def _simple(b: _Bytes, found: _Found, row, at, little, kind, dims, keep, part) -> np.ndarray:
    """Points, lines and polygons of many rows, all a step at a time; where each ends."""
    at = at.copy()
    one = kind == 1
    b.check(row[one], at[one] + 8 * dims[one])
    eight = b.data[at[one][:, None] + np.arange(8)]
    x = np.where(little[one], eight.view("<f8").ravel(), eight.view(">f8").ravel())
    some = np.flatnonzero(one)[~np.isnan(x)]  # a point without coordinates is NaN
    found.part(row[some], part[some])
    found.ring(row[some], part[some], 0, at[some], 1, dims[some], keep[some], little[some])
    at[one] += 8 * dims[one]
    rings = np.where(kind == 2, 1, 0)
    area = kind == 3
    rings[area] = b.number(row[area], at[area], little[area])
    at[area] += 4
    found.part(row[~one], part[~one])
    k = 0
    while (now := np.flatnonzero(rings > k)).size:
        n = b.number(row[now], at[now], little[now])
        found.ring(row[now], part[now], k, at[now] + 4, n, dims[now], keep[now], little[now])
        at[now] += 4 + 8 * n * dims[now]
        b.check(row[now], at[now])
        k += 1
    return at


def _listed(lengths: np.ndarray, values: pa.Array, mask: pa.Array | None = None) -> pa.Array:
    offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, values, mask=mask)


def _coordinates(b: _Bytes, rings: np.ndarray) -> np.ndarray:
    """All coordinates that stay, ring after ring: bytes are copied by rings, numbers made by kinds of rings."""
    start, n, dims, keep, little = rings[:, 3:].T
    ends = np.cumsum(n * keep)
    out, view = np.empty(int(ends[-1]) if len(ends) else 0), memoryview(b.data)
    kinds = np.unique(rings[:, 5:], axis=0) if len(rings) else []
    for d, k, order in kinds:
        of = np.flatnonzero((dims == d) & (keep == k) & (little == order))
        raw = b"".join([view[s : s + 8 * d * c] for s, c in zip(start[of].tolist(), n[of].tolist(), strict=True)])
        xy = np.frombuffer(raw, "<f8" if order else ">f8").reshape(-1, d)[:, :k].ravel()
        if len(kinds) == 1:
            return xy.astype(float)
        size = n[of] * k
        out[np.repeat(ends[of] - size - (np.cumsum(size) - size), size) + np.arange(len(xy))] = xy
    return out


def decode_arrays(raw: pa.Array) -> pa.Array:
    """Native geometries of many WKB values, of every type, byte order and dialect; no Python for single coordinates."""
    gone = pc.is_null(raw).to_numpy(zero_copy_only=False)
    b, found, row = _Bytes(raw), _Found(), np.flatnonzero(~gone)
    at, little, kind, dims, keep = b.head(row, b.starts[row])
    names = np.full(len(raw), None, object)
    names[row] = [NAMES[k] for k in kind.tolist()]
    plain = kind < 4
    _simple(b, found, *(v[plain] for v in (row, at, little, kind, dims, keep)), np.zeros(int(plain.sum()), np.int64))
    row, at, little = row[~plain], at[~plain], little[~plain]
    several = b.number(row, at, little)
    at, k = at + 4, 0
    while (now := np.flatnonzero(several > k)).size:
        body = b.head(row[now], at[now])
        at[now] = _simple(b, found, row[now], *body, np.full(len(now), k))
        k += 1
    parts, rings = _Found.sorted(found.parts, 2, 2), _Found.sorted(found.rings, 3, 8)
    per_row = np.bincount(parts[:, 0], minlength=len(raw))
    # The part that each ring belongs to, both in the order of rows and parts.
    wide = int(parts[:, 1].max()) + 1 if len(parts) else 1
    own = np.searchsorted(parts @ [wide, 1], rings[:, :2] @ [wide, 1])
    points = _listed(np.repeat(rings[:, 6], rings[:, 4]), pa.array(_coordinates(b, rings)))
    lists = _listed(np.bincount(own, minlength=len(parts)), _listed(rings[:, 4], points))
    return pa.StructArray.from_arrays([pa.array(names, pa.string()), _listed(per_row, lists)], ["type", "parts"], mask=pa.array(gone))


def encode_arrays(shapes: pa.Array) -> pa.Array:
    """Little-endian ISO WKB of native geometries, as ``encode`` gives it; coordinates are copied ring by ring."""
    kinds, levels = shapes.field("type").to_pylist(), [shapes.field("parts")]
    gone = (pc.is_null(shapes).to_numpy(zero_copy_only=False)) | pc.is_null(levels[0]).to_numpy(zero_copy_only=False)
    for _ in range(3):
        levels.append(pc.list_flatten(levels[-1]))
    per_row, per_part, per_ring, dims = (pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in levels)
    flat = pc.list_flatten(levels[-1]).to_numpy(zero_copy_only=False).astype("<f8")
    view = memoryview(flat.tobytes())
    ends = np.concatenate([[0], np.cumsum(dims)])  # of coordinates, by points
    ring_ends, part_ends, row_ends = (np.concatenate([[0], np.cumsum(x)]) for x in (per_ring, per_part, per_row))
    at_point = ends[ring_ends].tolist()
    low, high = ring_ends[part_ends[row_ends[:-1]]], ring_ends[part_ends[row_ends[1:]]]
    ring_list, part_list, row_list = ring_ends.tolist(), part_ends.tolist(), row_ends.tolist()
    two, three = (np.concatenate([[0], np.cumsum(dims == d)]) for d in (2, 3))
    size = high - low
    flat2, flat3 = two[high] - two[low] == size, (three[high] - three[low] == size) & (size > 0)
    out: list[bytes | None] = []
    for i, kind in enumerate(kinds):
        if gone[i] or kind is None:
            out.append(None)
            continue
        if not (flat2[i] or flat3[i]):
            out.append(encode(kind, levels[0][i].as_py()))
            continue
        z = bool(flat3[i])

        def line(r: int) -> bytes:
            return struct.pack("<I", ring_list[r + 1] - ring_list[r]) + view[8 * at_point[r] : 8 * at_point[r + 1]]

        def one(k: str, rings: range, z: bool = z) -> bytes:
            head = struct.pack("<BI", 1, CODES[k] + 1000 * z)
            if k == "Point":
                first = next((r for r in rings if ring_list[r + 1] > ring_list[r]), None) if len(rings) else None
                return head + (bytes(view[8 * at_point[first] : 8 * (at_point[first] + 2 + z)]) if first is not None else np.full(2 + z, np.nan).tobytes())
            if k == "LineString":
                return head + (line(rings[0]) if len(rings) else struct.pack("<I", 0))
            return head + struct.pack("<I", len(rings)) + b"".join([line(r) for r in rings])

        parts = [range(part_list[p], part_list[p + 1]) for p in range(row_list[i], row_list[i + 1])]
        if kind.startswith("Multi"):
            out.append(struct.pack("<BII", 1, CODES[kind] + 1000 * z, len(parts)) + b"".join([one(kind[5:], p) for p in parts]))
        else:
            out.append(one(kind, parts[0] if parts else range(0)))
    return pa.array(out, pa.binary())


def encode_many(kinds: Sequence[str | None], parts: Sequence) -> list[bytes | None]:
    """WKB of many geometries given as lists."""
    rows = [None if k is None or p is None else {"type": k, "parts": p} for k, p in zip(kinds, parts, strict=True)]
    return encode_arrays(pa.array(rows, ARROW)).to_pylist()


def decode_many(raw: Sequence[bytes | None]) -> list[tuple[str | None, list | None]]:
    """Geometries of many WKB values as lists."""
    rows = decode_arrays(pa.array(raw, pa.binary())).to_pylist()
    return [(None, None) if r is None else (r["type"], r["parts"]) for r in rows]


@arrow_udf(BinaryType())
def to_wkb(shapes: pa.Array) -> pa.Array:
    return encode_arrays(shapes)


@arrow_udf(TYPE)
def _from_wkb(raw: pa.Array) -> pa.Array:
    return decode_arrays(raw)


def from_wkb(raw: Column) -> Column:
    """The native geometry; null for null."""
    return _from_wkb(raw)
