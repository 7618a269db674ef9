"""Validity by comparing every segment with every other: what the packed rules are tested against."""

import math

import numpy as np


def _xy(r) -> np.ndarray:
    return np.array([[float(p[0]), float(p[1])] for p in r]).reshape(-1, 2)


def _distinct(r: np.ndarray) -> np.ndarray:
    """Without points that repeat the one before."""
    return r[np.concatenate([[True], (np.diff(r, axis=0) != 0).any(1)])] if len(r) else r


def _cross(a, b, c):
    return (b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0])


def crossings(a1: np.ndarray, a2: np.ndarray, b1: np.ndarray, b2: np.ndarray) -> np.ndarray:
    """Pairs (i, j) of segments a and b that share any point, by signs of areas and boxes."""
    a1, a2, b1, b2 = a1[:, None], a2[:, None], b1[None], b2[None]
    boxes = (np.minimum(a1, a2) <= np.maximum(b1, b2)).all(-1) & (np.minimum(b1, b2) <= np.maximum(a1, a2)).all(-1)
    s = np.sign
    straddle = (s(_cross(a1, a2, b1)) * s(_cross(a1, a2, b2)) <= 0) & (s(_cross(b1, b2, a1)) * s(_cross(b1, b2, a2)) <= 0)
    return np.argwhere(boxes & straddle)


def inside(p, ring: np.ndarray) -> int:
    """1 within a ring, 0 on it, -1 outside."""
    a, b = ring[:-1], ring[1:]
    on = (np.abs(_cross(a, b, np.asarray(p))) == 0) & (np.minimum(a, b) <= p).all(1) & (np.maximum(a, b) >= p).all(1)
    if on.any():
        return 0
    up = (a[:, 1] > p[1]) != (b[:, 1] > p[1])
    with np.errstate(divide="ignore", invalid="ignore"):
        x = (b[:, 0] - a[:, 0]) * (p[1] - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0]
    return 1 if (up & (p[0] < x)).sum() % 2 else -1


def _ring_problem(r: np.ndarray) -> str | None:
    if not np.isfinite(r).all():
        return "Invalid Coordinate"
    if len(r) and (r[0] != r[-1]).any():
        return "Ring is not closed"
    d = _distinct(r)
    if len(d) < 4:
        return "Too few points in geometry component"
    a, b, n = d[:-1], d[1:], len(d) - 1
    touches = False
    for i, j in crossings(a, b, a, b):
        if i >= j:
            continue
        ends = j == i + 1 or (i == 0 and j == n - 1)
        if ends:
            # Neighbours share one end; more than that is a spike that runs back on itself.
            p, q, t = (a[i], b[i], b[j]) if j == i + 1 else (a[j], b[j], b[i])
            if _cross(p, q, t) == 0 and np.dot(p - q, t - q) > 0:
                return "Self-intersection"
            continue
        touch = {tuple(a[i]), tuple(b[i])} & {tuple(a[j]), tuple(b[j])}
        proper = not touch and not any(_cross(x, y, z) == 0 for x, y, z in ((a[i], b[i], a[j]), (a[i], b[i], b[j]), (a[j], b[j], a[i]), (a[j], b[j], b[i])))
        if proper or not touch:
            return "Self-intersection"
        touches = True
    return "Ring Self-intersection" if touches else None


def _cross_properly(r: np.ndarray, s: np.ndarray) -> bool:
    """Whether rings cross, share a stretch of line, or pass through one another where they touch."""
    a1, a2, b1, b2 = r[:-1, None], r[1:, None], s[None, :-1], s[None, 1:]
    if bool(((_cross(a1, a2, b1) * _cross(a1, a2, b2) < 0) & (_cross(b1, b2, a1) * _cross(b1, b2, a2) < 0)).any()):
        return True
    sides = set()
    for p, q in zip(r, r[1:], strict=False):
        on = [e for e in s if _cross(p, q, e) == 0 and (np.minimum(p, q) <= e).all() and (e <= np.maximum(p, q)).all()]
        line = sorted([p, q, *on], key=lambda e: float(np.dot(e - p, q - p)))
        sides |= {inside((x + y) / 2, s) for x, y in zip(line, line[1:], strict=False) if (x != y).any()}
    return 0 in sides or {1, -1} <= sides


def _side(r: np.ndarray, other: np.ndarray) -> int:
    """Where r lies with respect to another ring that it does not cross."""
    middles = np.concatenate([r[:-1], (r[:-1] + r[1:]) / 2])
    return next((k for p in middles if (k := inside(p, other))), 0)


def problem(kind: str, parts) -> str | None:
    """Why a geometry is not valid; None if it is, or if it has no rules (points)."""
    if kind in ("Point", "MultiPoint"):
        return None if all(math.isfinite(c) for part in parts for r in part for p in r for c in p) else "Invalid Coordinate"
    if kind in ("LineString", "MultiLineString"):
        return "Too few points in geometry component" if any(len(_distinct(_xy(r))) < 2 for part in parts for r in part) else None
    shapes = [[_xy(r) for r in part] for part in parts]
    for rings in shapes:
        for r in rings:
            if found := _ring_problem(r):
                return found
        for k, hole in enumerate(rings[1:], 1):
            if _cross_properly(hole, rings[0]):
                return "Self-intersection"
            if _side(hole, rings[0]) < 0:
                return "Hole lies outside shell"
            for other in rings[1:k]:
                if _cross_properly(hole, other):
                    return "Self-intersection"
                if _side(hole, other) > 0 or _side(other, hole) > 0:
                    return "Holes are nested"
    for i, a in enumerate(shapes):
        for b in shapes[:i]:
            if _cross_properly(a[0], b[0]):
                return "Self-intersection"
            for x, y in ((a, b), (b, a)):
                if _side(x[0], y[0]) > 0 and not any(_side(x[0], h) > 0 for h in y[1:]):
                    return "Nested shells"
    return None
