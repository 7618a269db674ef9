"""Validity and repair against all pairs of segments, and against points by the even-odd rule."""

import time
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from featurekit.functions import planar, validity
from featurekit.functions.validity import invalid_reason, make_valid
from tests import brute_validity as brute


def square(x, y, s):
    return [[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]


def shapes(seed, count):
    rng = np.random.default_rng(seed)
    lattice = lambda n, m: [*(r := rng.integers(0, m, (n, 2)).astype(float).tolist()), r[0]]
    squares = lambda m: [square(*(rng.integers(0, 9, 2) + rng.integers(0, 2) * rng.random(2)).tolist(), float(rng.integers(1, m))) for _ in range(3)]
    for k in range(count):
        if k % 6 == 0:
            yield "Polygon", [[lattice(rng.integers(3, 8), 5)]]
        elif k % 6 == 1:
            yield "Polygon", [[lattice(4, 6), lattice(4, 6)]]
        elif k % 6 == 2:
            yield "Polygon", [[square(0.0, 0.0, 10.0), *squares(4)]]
        elif k % 6 == 3:
            yield "MultiPolygon", [[r] for r in squares(6)]
        elif k % 6 == 4:
            a, d = np.sort(rng.random(rng.integers(5, 60))) * 2 * np.pi, 0.5
            r = (np.stack([np.cos(a), np.sin(a)], 1) * (rng.random(len(a)) + d)[:, None]).tolist()
            yield "Polygon", [[[*r, r[0]]]]
        else:
            r = rng.random((rng.integers(4, 40), 2)).tolist()
            yield "Polygon", [[[*r, r[0]]]]


def packed(found):
    return pa.array([None if x is None else {"type": x[0], "parts": x[1]} for x in found], validity.ARROW)


@pytest.mark.parametrize("seed", [1, 2])
def test_reasons_equal_brute_force(seed):
    found = list(shapes(seed, 900))
    want = [brute.problem(k, p) for k, p in found]
    assert validity.problems(packed(found)) == want
    assert {None, "Self-intersection", "Nested shells", "Holes are nested", "Hole lies outside shell"} <= set(want)


def test_rings_that_touch():
    """Rings may touch in points; along lines, or through one another, they may not."""
    diamond = lambda x, y, s: [[x - s, y], [x, y - s], [x + s, y], [x, y + s], [x - s, y]]
    cases = [
        ([[square(0.0, 0.0, 4.0)], [square(2.0, 0.0, 4.0)]], "Self-intersection"),
        ([[square(0.0, 0.0, 4.0)], [square(4.0, 0.0, 4.0)]], "Self-intersection"),
        ([[square(0.0, 0.0, 4.0)], [square(0.0, 0.0, 4.0)]], "Self-intersection"),
        ([[square(0.0, 0.0, 4.0)], [square(4.0, 4.0, 4.0)]], None),
        ([[square(0.0, 0.0, 4.0)], [diamond(6.0, 2.0, 2.0)]], None),
        ([[square(0.0, 0.0, 4.0), diamond(2.0, 2.0, 2.0)]], None),
        ([[square(0.0, 0.0, 4.0), square(0.0, 1.0, 2.0)]], "Self-intersection"),
        ([[[[0.0, 0.0], [4.0, 0.0], [4.0, 2.0], [4.0, 4.0], [0.0, 4.0], [0.0, 0.0]]], [[[2.0, 2.0], [4.0, 2.0], [5.0, 1.0], [5.0, 3.0], [4.0, 2.0], [2.0, 3.0], [2.0, 2.0]]]], "Ring Self-intersection"),
        ([[[[0.0, 0.0], [4.0, 0.0], [4.0, 2.0], [4.0, 4.0], [0.0, 4.0], [0.0, 0.0]]], [[[3.0, 1.0], [4.0, 0.0], [6.0, 2.0], [4.0, 4.0], [3.0, 1.0]]]], "Self-intersection"),
    ]
    for parts, why in cases:
        kind = "MultiPolygon" if len(parts) > 1 else "Polygon"
        assert validity.problem(kind, parts) == brute.problem(kind, parts) == why, parts
        assert validity.problem(*validity.repair(kind, parts)) is None


def test_odd_shapes_of_a_batch():
    nan = float("nan")
    found = [None, ("Point", [[[[1.0, nan]]]]), ("Point", []), ("MultiPoint", [[[[1.0, 2.0, 3.0]]]]), ("LineString", [[[[0.0, 0.0], [0.0, 0.0]]]]), ("MultiLineString", [[[[0.0, 0.0], [1.0, 0.0]]], [[[1.0, 1.0]]]])]
    found += [("Polygon", []), ("Polygon", [[]]), ("MultiPolygon", [[square(0.0, 0.0, 1.0)], []]), ("Polygon", [[square(0.0, 0.0, 1.0)[:-1]]]), ("Polygon", [[[]]]), ("Polygon", [[[[0.0, 0.0, 5.0], [1.0, 0.0, 6.0], [0.0, 1.0, 7.0], [0.0, 0.0, 5.0]]]]), ("Curve", [])]
    few = "Too few points in geometry component"
    assert validity.problems(packed(found)) == [None, "Invalid Coordinate", None, None, few, few, None, None, None, "Ring is not closed", few, None, None]
    fixed = validity.repaired(packed(found)).to_pylist()
    assert str(fixed[:9]) == str(packed(found[:9]).to_pylist()) and fixed[10] == {"type": "MultiPolygon", "parts": []}
    assert fixed[9]["parts"][0][0][0] == fixed[9]["parts"][0][0][-1]
    assert validity.problems(packed([])) == [] and len(validity.repaired(packed([]))) == 0


def parity(parts, points):
    rings = [brute._xy(r) for part in parts for r in part]
    return [sum(brute.inside(p, r) > 0 for r in rings) % 2 for p in points]


def test_repair_fills_what_the_even_odd_rule_fills():
    rng = np.random.default_rng(3)
    found = list(shapes(3, 600))
    fixed = validity.repaired(packed(found)).to_pylist()
    assert validity.problems(packed([(f["type"], f["parts"]) for f in fixed])) == [None] * len(fixed)
    assert all(brute.problem(f["type"], f["parts"]) is None for f in fixed[::10])
    for (kind, parts), f in zip(found, fixed, strict=True):
        xy = np.concatenate([brute._xy(r) for part in parts for r in part])
        points = xy.min(0) + (xy.max(0) - xy.min(0)) * rng.random((12, 2))
        assert parity(parts, points) == parity(f["parts"], points)


def test_nested_and_touching_lines():
    """Rings within rings, a hole that touches its shell, and lines that lie on each other."""
    nested = [[square(0.0, 0.0, 9.0), square(1.0, 1.0, 7.0), square(2.0, 2.0, 5.0), square(3.0, 3.0, 1.0)[::-1]]]
    kind, parts = validity.repair("Polygon", nested)
    assert kind == "MultiPolygon" and sorted(len(p) for p in parts) == [2, 2]
    kind, parts = validity.repair("Polygon", [[square(0.0, 0.0, 4.0), [[0.0, 0.0], [2.0, 1.0], [1.0, 2.0], [0.0, 0.0]], square(9.0, 9.0, 1.0)]])
    assert kind == "MultiPolygon" and sorted(len(p) for p in parts) == [1, 2]
    kind, parts = validity.repair("MultiPolygon", [[square(0.0, 0.0, 4.0)], [square(2.0, 1.0, 4.0)]])
    area = lambda r: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:]))) / 2
    assert sorted(area(r) for p in parts for r in p) == [10, 10]


def test_orientation_is_exact():
    rng = np.random.default_rng(4)
    a, d = rng.random((400, 2)) * [[1e3, 1e-3]], rng.random((400, 2))
    b = a + d
    c = a + d * rng.integers(1, 9, (400, 1)) / 3  # on the line but for rounding
    c[::7] = np.nextafter(c[::7], 9)
    area = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    want = [area(*([Fraction(float(z)) for z in p] for p in t)) for t in zip(a, b, c, strict=True)]
    got = planar.orientation(a, b, c)
    assert got.tolist() == [(w > 0) - (w < 0) for w in want]


def test_pairs_of_boxes_are_all_pairs():
    rng = np.random.default_rng(5)
    for n in (2, 3, 24, 25, 300):
        a = rng.random((n, 2))
        b = a + rng.random((n, 2)) * 0.2 - 0.1
        counts = np.array([n, n]) if n < 100 else np.array([n])
        if len(counts) == 2:
            a, b = np.concatenate([a, a]), np.concatenate([b, b])
        got = {(i, j) for x, y, *_ in planar.meeting(a, b, counts) for i, j in zip(x.tolist(), y.tolist(), strict=True)}
        want = {(i + k, j + k) for i, j in brute.crossings(a[:n], b[:n], a[:n], b[:n]) if i < j for k in range(0, n * len(counts), n)}
        assert got == want


def test_rings_of_a_hundred_thousand_points():
    n = 100_000
    rng = np.random.default_rng(6)
    a = np.arange(n) * 2 * np.pi / n
    r = (np.stack([np.cos(a), np.sin(a)], 1) * (1 + 0.3 * np.sin(50 * a) + 1e-4 * rng.random(n))[:, None]).tolist()
    comb = [[float(i), 1000.0 * (i % 2)] for i in range(n)] + [[float(n), -1.0], [0.0, -1.0], [0.0, 0.0]]
    began = time.monotonic()
    assert validity.problem("Polygon", [[[*r, r[0]]]]) is None and validity.problem("Polygon", [[comb]]) is None
    r[100], r[130] = r[130], r[100]
    assert validity.problem("Polygon", [[[*r, r[0]]]]) == "Self-intersection"
    kind, parts = validity.repair("Polygon", [[[*r, r[0]]]])
    assert kind == "MultiPolygon" and validity.problem(kind, parts) is None
    assert time.monotonic() - began < 60


def test_in_a_plan(spark):
    found = [*shapes(7, 60), None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(found)], "id int, g struct<type:string,parts:array<array<array<array<double>>>>>").repartition(3)
    rows = df.select("id", invalid_reason(F.col("g")).alias("why"), make_valid(F.col("g")).alias("fixed")).withColumn("after", invalid_reason(F.col("fixed"))).orderBy("id").collect()
    assert [r["why"] for r in rows] == [None if x is None else brute.problem(*x) for x in found]
    assert all(r["after"] is None for r in rows) and rows[-1]["fixed"] is None


def test_shells_that_touch_are_not_searched(monkeypatch):
    """Shells whose boxes share a corner or an edge at most are judged by their boxes; those that share a line still cross."""
    from featurekit.functions import validity

    asked = []
    monkeypatch.setattr(validity, "inside", lambda p, ring, f=validity.inside: asked.append(1) or f(p, ring))
    left, right = [[0, 0], [1, 1], [0, 2], [0, 0]], [[1, 1], [2, 0], [2, 2], [1, 1]]
    assert validity.problem("MultiPolygon", [[left], [right]]) is None
    assert not asked
    square = lambda x: [[x, 0], [x + 1, 0], [x + 1, 1], [x, 1], [x, 0]]
    assert validity.problem("MultiPolygon", [[square(0)], [square(1)]]) == "Self-intersection"
