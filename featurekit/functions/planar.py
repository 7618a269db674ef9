"""Segments of many geometries in packed arrays: exact orientation, pairs that meet, and the faces that lines enclose.

All functions work on whole Arrow batches at once. Pairs of segments that may meet are found through boxes: all pairs of
small geometries, and for large ones a tree of boxes over segments in ring order that is joined with itself level by level,
so that a ring of a hundred thousand points takes seconds and bounded memory."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Segments up to which all pairs of a geometry are tried, fan-out of the tree of boxes, pairs that are held at once.
SMALL, FAN, HELD = 24, 4, 1 << 18
#: Relative error bound of an orientation's sign, in double precision.
_BOUND = 3.4e-16


def repeated(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each value as often as its count says, and the place of each within its run."""
    out = np.repeat(values, counts)
    return out, np.arange(len(out)) - np.repeat(np.cumsum(counts) - counts, counts)


def _two_product(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The product and what rounding took from it."""

    def halves(v):
        c = 134217729.0 * v
        high = c - (c - v)
        return high, v - high

    p, (xh, xl), (yh, yl) = x * y, halves(x), halves(y)
    return p, xl * yl - (((p - xh * yh) - xl * yh) - xh * yl)


def _difference(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The difference, and whether it is exact."""
    d = x - y
    z = d - x
    return d, ((x - (d - z)) + (z * -1.0 - y)) == 0


def _exact(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    (u, eu), (v, ev), (w, ew), (x, ex) = (
        _difference(b[:, 0], a[:, 0]), _difference(c[:, 1], a[:, 1]), _difference(b[:, 1], a[:, 1]), _difference(c[:, 0], a[:, 0]),
    )
    (p, ep), (q, eq) = _two_product(u, v), _two_product(w, x)
    sign = np.where(p == q, np.sign(ep - eq), np.sign(p - q))
    sure = eu & ev & ew & ex & ((p == q) | (np.abs(p - q) > np.abs(ep) + np.abs(eq)))
    for k in np.flatnonzero(~sure):
        f = [Fraction(float(z)) for z in (*a[k], *b[k], *c[k])]
        area = (f[2] - f[0]) * (f[5] - f[1]) - (f[3] - f[1]) * (f[4] - f[0])
        sign[k] = (area > 0) - (area < 0)
    return sign


def orientation(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """1 where a, b, c turn to the left, -1 to the right, 0 on one line; exact."""
    a, b, c = np.broadcast_arrays(a, b, c)
    left, right = (b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]), (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])
    sign = np.sign(left - right)
    close = np.flatnonzero(np.abs(left - right) <= _BOUND * (np.abs(left) + np.abs(right)))
    if len(close):
        sign[close] = _exact(a[close], b[close], c[close])
    return sign.astype(np.int8)


def _boxes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds along x, y and both diagonals, so that slanting segments have narrow ones too."""
    axes = np.array([[1.0, 0.0, 1.0, 1.0], [0.0, 1.0, 1.0, -1.0]])
    p, q = a @ axes, b @ axes
    low, high = np.minimum(p, q), np.maximum(p, q)
    # Sums of coordinates are rounded.
    low[:, 2:] -= np.abs(low[:, 2:]) * 1e-15 + 1e-300
    high[:, 2:] += np.abs(high[:, 2:]) * 1e-15 + 1e-300
    return low, high


def _tree_pairs(low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs i < j whose bounds overlap, in stretches of bounded size."""
    levels = [(low, high)]
    while len(levels[-1][0]) > FAN:
        at = np.arange(0, len(levels[-1][0]), FAN)
        levels.append((np.minimum.reduceat(levels[-1][0], at), np.maximum.reduceat(levels[-1][1], at)))
    i, j = np.triu_indices(len(levels[-1][0]))
    stack = [(len(levels) - 1, i, j)]
    child_i, child_j = np.repeat(np.arange(FAN), FAN), np.tile(np.arange(FAN), FAN)
    while stack:
        level, i, j = stack.pop()
        lo, hi = levels[level]
        keep = (lo[i] <= hi[j]).all(1) & (lo[j] <= hi[i]).all(1)
        i, j = i[keep], j[keep]
        if level == 0:
            keep = i < j
            if keep.any():
                yield i[keep], j[keep]
            continue
        n = len(levels[level - 1][0])
        for at in range(0, len(i), HELD // FAN**2):
            x = (i[at : at + HELD // FAN**2, None] * FAN + child_i).ravel()
            y = (j[at : at + HELD // FAN**2, None] * FAN + child_j).ravel()
            keep = (x < n) & (y < n) & (x <= y)
            stack.append((level - 1, x[keep], y[keep]))


def near_pairs(a: np.ndarray, b: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs i < j of segments of one geometry whose boxes overlap; ``counts`` says how many segments each geometry has."""
    begins = np.cumsum(counts) - counts
    for m in np.unique(counts[(counts > 1) & (counts <= SMALL)]):
        starts = begins[counts == m]
        x, y = np.triu_indices(m, 1)
        step = max(HELD // len(x), 1)
        for at in range(0, len(starts), step):
            i, j = (starts[at : at + step, None] + x).ravel(), (starts[at : at + step, None] + y).ravel()
            low, high = (lambda k: np.minimum(a[k], b[k])), (lambda k: np.maximum(a[k], b[k]))
            keep = (low(i) <= high(j)).all(1) & (low(j) <= high(i)).all(1)
            yield i[keep], j[keep]
    for g in np.flatnonzero(counts > SMALL):
        s = slice(begins[g], begins[g] + counts[g])
        for i, j in _tree_pairs(*_boxes(a[s], b[s])):
            yield i + begins[g], j + begins[g]


def meeting(a: np.ndarray, b: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Pairs of segments that share a point, with the four orientations: of j's ends from i, of i's ends from j."""
    for i, j in near_pairs(a, b, counts):
        boxes = (np.minimum(a[i], b[i]) <= np.maximum(a[j], b[j])).all(1) & (np.minimum(a[j], b[j]) <= np.maximum(a[i], b[i])).all(1)
        i, j = i[boxes], j[boxes]
        o1, o2 = orientation(a[i], b[i], a[j]), orientation(a[i], b[i], b[j])
        o3, o4 = orientation(a[j], b[j], a[i]), orientation(a[j], b[j], b[i])
        meet = (o1 * o2 <= 0) & (o3 * o4 <= 0)
        if meet.any():
            yield tuple(v[meet] for v in (i, j, o1, o2, o3, o4))


@dataclass
class Packed:
    """Rings of many geometries: points, how many of them each ring has, the part and geometry of each ring."""

    xy: np.ndarray
    points: np.ndarray
    part: np.ndarray
    shape: np.ndarray

    @classmethod
    def of(cls, parts: pa.Array) -> Packed:
        """From lists of parts of rings of points of coordinates; nulls have no parts."""
        per_shape = pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False)
        rings = pc.list_flatten(parts)
        per_part = pc.fill_null(pc.list_value_length(rings), 0).to_numpy(zero_copy_only=False)
        points = pc.list_flatten(rings)
        per_ring = pc.fill_null(pc.list_value_length(points), 0).to_numpy(zero_copy_only=False)
        coordinates = pc.list_flatten(points)
        dims = pc.list_value_length(coordinates).to_numpy(zero_copy_only=False)
        flat = pc.fill_null(pc.list_flatten(coordinates), np.nan).to_numpy(zero_copy_only=False)
        first = np.cumsum(dims) - dims
        part = np.repeat(np.arange(len(per_part)), per_part)
        xy = np.stack([flat[first], flat[first + 1]], 1) if len(first) else np.empty((0, 2))
        return cls(xy, per_ring.astype(np.int64), part, np.repeat(np.arange(len(per_shape)), per_shape)[part])

    def ring_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.points)), self.points)

    def first(self) -> np.ndarray:
        return np.cumsum(self.points) - self.points

    def keep(self, wanted: np.ndarray) -> Packed:
        """Some rings only."""
        return Packed(self.xy[wanted[self.ring_of()]], self.points[wanted], self.part[wanted], self.shape[wanted])

    def closed(self) -> Packed:
        """With each ring's first point at its end too."""
        first, last = self.first(), np.cumsum(self.points) - 1
        add = (self.xy[first] != self.xy[last]).any(1) if len(first) else np.zeros(0, bool)
        xy = np.insert(self.xy, last[add] + 1, self.xy[first[add]], axis=0)
        return Packed(xy, self.points + add, self.part, self.shape)

    def distinct(self) -> Packed:
        """Without points that repeat the one before."""
        ring = self.ring_of()
        new = np.ones(len(ring), bool)
        new[1:] = (self.xy[1:] != self.xy[:-1]).any(1) | (ring[1:] != ring[:-1])
        return Packed(self.xy[new], np.bincount(ring[new], minlength=len(self.points)), self.part, self.shape)

    def segments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Both ends of every segment, its ring, and its number within the ring."""
        ring, k = repeated(np.arange(len(self.points)), np.maximum(self.points - 1, 0))
        at = self.first()[ring] + k
        return self.xy[at], self.xy[at + 1], ring, k
