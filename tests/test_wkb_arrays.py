"""WKB by arrays against the plain codec, for every type, byte order and dialect."""

import math
import struct
import time

import numpy as np
import pyarrow as pa
import pytest

from featurekit.functions import wkb

KINDS = list(wkb.CODES)


def shape(rng, kind, dims):
    line = lambda n: rng.random((n, dims)).tolist()
    part = lambda k: [line(1)] if k == "Point" else [line(rng.integers(0, 5))] if k == "LineString" else [line(rng.integers(0, 6)) for _ in range(rng.integers(0, 4))]
    if kind.startswith("Multi"):
        return [part(kind[5:]) for _ in range(rng.integers(0, 4))]
    return [] if kind == "Point" and rng.random() < 0.2 else [part(kind)]


def raw(kind, parts, dims, order, ewkb, m):
    """WKB written by the format's description, with a measure and a reference system if asked for."""
    pack = lambda fmt, *v: struct.pack(order + fmt, *v)

    def head(k, top):
        code = wkb.CODES[k] + (0 if ewkb else 1000 * ((dims == 3) + 2 * m))
        if ewkb:
            code |= (0x80000000 if dims == 3 else 0) | (0x40000000 if m else 0) | (0x20000000 if top else 0)
        return pack("BI", 1 if order == "<" else 0, code) + (pack("I", 4326) if ewkb and top else b"")

    point = lambda p: pack(f"{dims + m}d", *p, *([9.0] * m))
    line = lambda r: pack("I", len(r)) + b"".join(map(point, r))

    def one(k, part, top):
        if k == "Point":
            return head(k, top) + point(part[0][0] if part else [math.nan] * dims)
        if k == "LineString":
            return head(k, top) + line(part[0])
        return head(k, top) + pack("I", len(part)) + b"".join(map(line, part))

    if kind.startswith("Multi"):
        return head(kind, True) + pack("I", len(parts)) + b"".join(one(kind[5:], p, False) for p in parts)
    return one(kind, parts[0] if parts else [], True)


def test_every_type_order_and_dialect():
    rng = np.random.default_rng(1)
    values = [None]
    for k in range(1200):
        kind, dims = KINDS[k % 6], int(rng.integers(2, 4))
        values.append(raw(kind, shape(rng, kind, dims), dims, "<>"[k // 6 % 2], bool(k // 12 % 2), int(k // 24 % 2)))
    order = rng.permutation(len(values))
    values = [values[i] for i in order]
    want = [(None, None) if v is None else wkb.decode(v) for v in values]
    assert wkb.decode_many(values) == want
    for some in (pa.array(values, pa.large_binary()), pa.array([b"", *values, b""], pa.binary())[1:-1]):
        assert wkb.decode_arrays(some).to_pylist() == [None if k is None else {"type": k, "parts": p} for k, p in want]
    again = wkb.encode_many(*zip(*want, strict=True))
    assert again == [None if k is None else wkb.encode(k, p) for k, p in want]
    sliced = pa.array([{"type": "Point", "parts": []}, *({"type": k, "parts": p} if k else None for k, p in want)], wkb.ARROW)[1:]
    assert wkb.encode_arrays(sliced).to_pylist() == again
    assert wkb.decode_many([]) == [] and wkb.encode_many([], []) == []


def test_mixed_dimensions():
    odd = [("LineString", [[[[0.0, 1.0], [2.0, 3.0, 4.0]]]]), ("Point", [[[[1.0, 2.0, 3.0, 4.0]]]]), ("MultiPoint", [[[[1.0, 2.0]]], []])]
    assert wkb.encode_many(*zip(*odd, strict=True)) == [wkb.encode(k, p) for k, p in odd]


def test_what_is_not_read():
    with pytest.raises(ValueError, match="type 7"):
        wkb.decode_many([struct.pack("<BII", 1, 7, 0)])
    with pytest.raises(ValueError, match="type 7"):
        wkb.decode(struct.pack("<BII", 1, 7, 0))
    for cut in (3, 10, 30):
        with pytest.raises(ValueError, match="too early"):
            wkb.decode_many([wkb.encode("LineString", [[[[0.0, 1.0], [2.0, 3.0]]]])[:cut], wkb.encode("Point", [[[[1.0, 2.0]]]])])


def test_multipolygons_are_read_much_faster():
    rng = np.random.default_rng(2)
    values = [wkb.encode("MultiPolygon", [[rng.random((60, 2)).tolist(), rng.random((20, 2)).tolist()] for _ in range(3)]) for _ in range(400)] * 5
    arrow = pa.array(values, pa.binary())
    began = time.perf_counter()
    found = wkb.decode_arrays(arrow)
    fast = time.perf_counter() - began
    began = time.perf_counter()
    want = [wkb.decode(v) for v in values]
    slow = time.perf_counter() - began
    assert found.to_pylist() == [{"type": k, "parts": p} for k, p in want]
    assert fast < slow
    print(f"decode {slow / fast:.0f} times faster")
