"""Validity of geometries, the reason where they are not, and repair. Exact rules of planar simplicity, on packed arrays of
whole Arrow batches."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

from featurekit.functions.geometry import TYPE
from featurekit.functions.planar import Packed, meeting, orientation
from featurekit.functions.wkb import ARROW

_COORDINATES, _OPEN, _FEW = "Invalid Coordinate", "Ring is not closed", "Too few points in geometry component"
_CROSSES, _TOUCHES, _OUTSIDE = "Self-intersection", "Ring Self-intersection", "Hole lies outside shell"
_HOLES, _SHELLS = "Holes are nested", "Nested shells"


def inside(p: np.ndarray, ring: np.ndarray) -> int:
    """1 within a closed ring, 0 on it, -1 outside."""
    a, b = ring[:-1], ring[1:]
    box = (np.minimum(a, b) <= p).all(1) & (np.maximum(a, b) >= p).all(1)
    if box.any() and (orientation(a[box], b[box], p[None]) == 0).any():
        return 0
    up = (a[:, 1] > p[1]) != (b[:, 1] > p[1])
    a, b = a[up], b[up]
    # An edge that crosses the height of p does so to its right if p lies to the left of the edge as it goes up.
    return 1 if len(a) and ((orientation(a, b, p[None]) > 0) == (b[:, 1] > a[:, 1])).sum() % 2 else -1


def _side(r: np.ndarray, other: np.ndarray) -> int:
    """Where a ring lies with respect to another that it does not cross: by its first point or middle that is not on it."""
    for p in r[:-1]:
        if k := inside(p, other):
            return k
    return next((k for p in (r[:-1] + r[1:]) / 2 if (k := inside(p, other))), 0)


class _Rings:
    """The rings of a batch's polygons: what is wrong with each by itself, and which cross one another."""

    def __init__(self, packed: Packed):
        self.packed = packed
        n = len(packed.points)
        ring = packed.ring_of()
        bad = np.bincount(ring[~np.isfinite(packed.xy).all(1)], minlength=n) > 0
        some = packed.points > 0
        first, last = packed.first(), np.cumsum(packed.points) - 1
        loose = np.zeros(n, bool)
        loose[some] = (packed.xy[first[some]] != packed.xy[last[some]]).any(1)
        self.distinct = packed.distinct()
        few = self.distinct.points < 4
        self.problem = np.select([bad, loose, few], [_COORDINATES, _OPEN, _FEW], "").astype(object)
        self.crossing: set[tuple[int, int]] = set()
        self.touching: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        self._meetings(self.problem == "")
        self.starts = self.distinct.first()
        some = np.flatnonzero(self.distinct.points > 0)
        low, high = (np.full((n, 2), np.nan) for _ in range(2))
        if len(some):
            low[some], high[some] = (f.reduceat(self.distinct.xy, self.starts[some]) for f in (np.minimum, np.maximum))
        self.boxes = list(zip(*low.T.tolist(), *high.T.tolist(), strict=True))

    def _meetings(self, sound: np.ndarray) -> None:
        index = np.flatnonzero(sound)
        kept = self.distinct.keep(sound)
        a, b, ring, k = kept.segments()
        n = (kept.points - 1)[ring] if len(ring) else ring
        shape = kept.shape[ring] if len(ring) else ring
        crosses, touches = np.zeros(len(index), bool), np.zeros(len(index), bool)
        for i, j, o1, o2, o3, o4 in meeting(a, b, np.unique(shape, return_counts=True)[1]):
            proper = (o1 * o2 < 0) & (o3 * o4 < 0)
            apart = ring[i] != ring[j]
            # Rings may meet in points, but not along a line.
            share = np.minimum(np.maximum(a[i], b[i]), np.maximum(a[j], b[j])) > np.maximum(np.minimum(a[i], b[i]), np.minimum(a[j], b[j]))
            along = (o1 == 0) & (o2 == 0) & (o3 == 0) & (o4 == 0) & share.any(1)
            other = apart & (proper | along)
            self.crossing.update(zip(index[ring[i[other]]].tolist(), index[ring[j[other]]].tolist(), strict=True))
            m = apart & ~other
            for r, s, x, y in zip(index[ring[i[m]]].tolist(), index[ring[j[m]]].tolist(), k[i[m]].tolist(), k[j[m]].tolist(), strict=True):
                self.touching[r, s].append((x, y))
            own = ring[i] == ring[j]
            i, j = i[own], j[own]
            flat = (o1 == 0) | (o2 == 0) | (o3 == 0) | (o4 == 0)
            after, around = k[j] == k[i] + 1, (k[i] == 0) & (k[j] == n[i] - 1)
            # Neighbours share one end; more than that is a spike that runs back on itself.
            p = np.where(after[:, None], a[i], a[j])
            q = np.where(after[:, None], b[i], b[j])
            t = np.where(after[:, None], b[j], b[i])
            ends = after | around
            back = ends & (((p - q) * (t - q)).sum(1) > 0)
            if back.any():
                back[back] = orientation(p[back], q[back], t[back]) == 0
            same = lambda u, v: (u == v).all(1)
            touch = same(a[i], a[j]) | same(a[i], b[j]) | same(b[i], a[j]) | same(b[i], b[j])
            cross = back | (~ends & ~touch)
            crosses[ring[i[cross]]] = True
            touches[ring[i[~ends & touch & flat[own]]]] = True
        self.problem[index[touches]] = _TOUCHES
        self.problem[index[crosses]] = _CROSSES

    def ring(self, r: int) -> np.ndarray:
        return self.distinct.xy[self.starts[r] : self.starts[r] + self.distinct.points[r]]

    def apart(self, r: int, s: int) -> bool:
        """Whether the boxes of two rings share no point."""
        (a, b, c, d), (e, f, g, h) = self.boxes[r], self.boxes[s]
        return a > g or b > h or e > c or f > d

    def beside(self, r: int, s: int) -> bool:
        """Whether their boxes share an edge or a corner at most: neither ring has a point within the other."""
        (a, b, c, d), (e, f, g, h) = self.boxes[r], self.boxes[s]
        return a >= g or b >= h or e >= c or f >= d

    def cross(self, r: int, s: int) -> bool:
        if (r, s) in self.crossing or (s, r) in self.crossing:
            return True
        if self.beside(r, s):
            return False
        found = self.touching.get((r, s)) or [(j, i) for i, j in self.touching.get((s, r), ())]
        return bool(found) and self._through(self.ring(r), self.ring(s), found)

    @staticmethod
    def _through(r: np.ndarray, s: np.ndarray, found: list[tuple[int, int]]) -> bool:
        """Whether a ring passes from one side of another to the other where they touch: by the middles of the pieces into
        which the touching segments are cut."""
        sides = set()
        for i in {i for i, _ in found}:
            p, q = r[i], r[i + 1]
            ends = np.array([e for k, j in found if k == i for e in (s[j], s[j + 1])])
            on = (orientation(p[None], q[None], ends) == 0) & (np.minimum(p, q) <= ends).all(1) & (ends <= np.maximum(p, q)).all(1)
            line = np.concatenate([[p, q], ends[on]])
            line = line[np.argsort(((line - p) * (q - p)).sum(1), kind="stable")]
            for mid in (line[1:] + line[:-1])[(line[1:] != line[:-1]).any(1)] / 2:
                sides.add(inside(mid, s))
                if {1, -1} <= sides:
                    return True
        return False


def _shape_problem(rings: _Rings, parts: list[list[int]]) -> str | None:
    """Why a polygon of several rings is not valid, in the order in which its rings stand."""
    for own in parts:
        for r in own:
            if rings.problem[r]:
                return rings.problem[r]
        for k, hole in enumerate(own[1:], 1):
            if rings.cross(hole, own[0]):
                return _CROSSES
            if rings.apart(hole, own[0]) or _side(rings.ring(hole), rings.ring(own[0])) < 0:
                return _OUTSIDE
            for other in own[1:k]:
                if rings.apart(hole, other):
                    continue
                if rings.cross(hole, other):
                    return _CROSSES
                if _side(rings.ring(hole), rings.ring(other)) > 0 or _side(rings.ring(other), rings.ring(hole)) > 0:
                    return _HOLES
    within = lambda r, s: not rings.beside(r, s) and _side(rings.ring(r), rings.ring(s)) > 0
    shells = [p for p in parts if p]
    for i, a in enumerate(shells):
        for b in shells[:i]:
            if rings.apart(a[0], b[0]):
                continue
            if rings.cross(a[0], b[0]):
                return _CROSSES
            for x, y in ((a, b), (b, a)):
                if within(x[0], y[0]) and not any(within(x[0], h) for h in y[1:]):
                    return _SHELLS
    return None


def problems(shapes: pa.Array) -> list[str | None]:
    """Why each geometry of a batch is not valid; None for those that are, that have no rules, and for nulls."""
    kinds = shapes.field("type").to_numpy(zero_copy_only=False)
    lists = shapes.field("parts")
    gone = pc.is_null(shapes).to_numpy(zero_copy_only=False)
    out: list[str | None] = [None] * len(shapes)
    is_a = lambda *names: np.isin(np.where(gone | (kinds == None), "", kinds).astype(str), names)  # noqa: E711, E731
    for name, chosen in (("points", is_a("Point", "MultiPoint")), ("lines", is_a("LineString", "MultiLineString"))):
        at = np.flatnonzero(chosen)
        if not len(at):
            continue
        packed = Packed.of(lists.take(pa.array(at)))
        if name == "points":
            bad = packed.shape[packed.ring_of()[~np.isfinite(packed.xy).all(1)]]
        else:
            bad = packed.shape[packed.distinct().points < 2]
        for k in np.unique(bad):
            out[at[k]] = _COORDINATES if name == "points" else _FEW
    at = np.flatnonzero(is_a("Polygon", "MultiPolygon"))
    if not len(at):
        return out
    packed = Packed.of(lists.take(pa.array(at)))
    rings = _Rings(packed)
    several = np.bincount(packed.shape, minlength=len(at)) > 1
    alone = np.flatnonzero(~several[packed.shape] & (rings.problem != ""))
    for r in alone:
        out[at[packed.shape[r]]] = rings.problem[r]
    members: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
    for r in np.flatnonzero(several[packed.shape]):
        members[packed.shape[r]][packed.part[r]].append(r)
    for shape, parts in members.items():
        out[at[shape]] = _shape_problem(rings, list(parts.values()))
    return out


def _cut(a: np.ndarray, b: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes (place and geometry), and edges between them: all segments cut where they meet; edges that lie on each other
    cancel in pairs (even-odd rule)."""
    edge, where = [np.arange(len(a))] * 2, [a, b]
    for i, j, *_ in meeting(a, b, np.unique(shape, return_counts=True)[1]):
        d, e = b[i] - a[i], b[j] - a[j]
        den = d[:, 0] * e[:, 1] - d[:, 1] * e[:, 0]
        off = a[j] - a[i]
        line = orientation(a[i], b[i], a[j]) == 0
        along = line & (orientation(a[i], b[i], b[j]) == 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            p = a[i] + ((off[:, 0] * e[:, 1] - off[:, 1] * e[:, 0]) / den)[:, None] * d
        # An end that lies there is the place itself.
        for q in (b[j], a[j], b[i], a[i]):
            close = (np.abs(q - p) <= 1e-12 * (1 + np.abs(q).max(1, keepdims=True))).all(1)
            p = np.where(close[:, None], q, p)
        single = ~along & (den != 0)
        edge += [i[single], j[single], i[along], i[along], j[along], j[along]]
        where += [p[single], p[single], a[j][along], b[j][along], a[i][along], b[i][along]]
    edge, xy = np.concatenate(edge), np.concatenate(where)
    d = (b - a)[edge]
    t = ((xy - a[edge]) * d).sum(1) / (d * d).sum(1)
    keep = (t >= -1e-12) & (t <= 1 + 1e-12)
    edge, xy, t = edge[keep], xy[keep] + 0.0, t[keep]
    nodes, number = np.unique(np.column_stack([shape[edge].astype(float), xy]), axis=0, return_inverse=True)
    number = _snapped(nodes, number.ravel(), t)[number.ravel()]
    order = np.lexsort((t, edge))
    edge, number = edge[order], number[order]
    step = (edge[1:] == edge[:-1]) & (number[1:] != number[:-1])
    u, v = number[:-1][step], number[1:][step]
    pairs, times = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], 1).reshape(-1, 2), axis=0, return_counts=True)
    pairs = pairs[times % 2 == 1]
    return nodes[:, 1:], nodes[:, 0].astype(np.int64), pairs[:, 0], pairs[:, 1]


def _snapped(nodes: np.ndarray, number: np.ndarray, t: np.ndarray) -> np.ndarray:
    """For each node the one that stands for it: places that differ by rounding only are one, a given point rather than a
    computed one. They share a cell of a fine grid, or of the same grid moved by half a cell."""
    n = len(nodes)
    shape = nodes[:, 0].astype(np.int64)
    size = np.ones(shape.max() + 1)
    np.maximum.at(size, shape, np.abs(nodes[:, 1:]).max(1))
    grid = nodes[:, 1:] / (size[shape] * 2.0**-38)[:, None]
    cells = [np.unique(np.column_stack([nodes[:, 0], np.floor(grid + shift)]), axis=0, return_inverse=True)[1].ravel() for shift in ([0, 0], [0.5, 0.5], [0, 0.5], [0.5, 0])]
    computed = np.ones(n, bool)
    computed[number[(t == 0) | (t == 1)]] = False
    order = np.argsort(computed, kind="stable")
    label = np.empty(n, np.int64)
    label[order] = np.arange(n)
    while True:
        before = label
        for cell in cells:
            least = np.full(n, n)
            np.minimum.at(least, cell, label)
            label = least[cell]
        if (label == before).all():
            return order[label]


def _least(label: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The least label on each cycle of a permutation, by doubling the step."""
    while True:
        new = np.minimum(label, label[following])
        if (new == label).all() and (label[following] == label).all():
            return label
        label, following = new, following[following]


def _odd_faces(face: np.ndarray, twin: np.ndarray, area: np.ndarray, outer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every face the walk around the outside of the lines that it belongs to, and whether an odd number of edges lies
    between; faces on both sides of an edge differ."""
    owner, odd = np.where(outer, np.arange(len(area)), -1), np.zeros(len(area), bool)
    here, there = face, face[twin]
    while True:
        new = (owner[here] >= 0) & (owner[there] < 0)
        if not new.any():
            return owner, odd
        odd[there[new]] = ~odd[here[new]]
        owner[there[new]] = owner[here[new]]


def _simple(walk: list[int]) -> list[list[int]]:
    """A closed walk as rings that pass no node twice."""
    out, path, at = [], [], {}
    for v in walk:
        if v in at:
            out.append(path[at[v] :])
            for w in path[at[v] :]:
                del at[w]
            path = path[: len(path) - len(out[-1])]
        at[v] = len(path)
        path.append(v)
    return [*out, path] if path else out


def _area(r: np.ndarray) -> float:
    r = r - r[0]
    return float((r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1]).sum() / 2)


def _faces(xy: np.ndarray, shape: np.ndarray, u: np.ndarray, v: np.ndarray, count: int) -> list[list[list[np.ndarray]]]:
    """For each of ``count`` geometries, the polygons (shell and holes) that its edges fill by the even-odd rule."""
    out: list[list[list[np.ndarray]]] = [[] for _ in range(count)]
    if not len(u):
        return out
    tail, head = np.concatenate([u, v]), np.concatenate([v, u])
    d = xy[head] - xy[tail]
    order = np.lexsort((np.arctan2(d[:, 1], d[:, 0]), tail))
    tail, head = tail[order], head[order]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    twin = rank[(order + len(u)) % len(order)]
    first, degree = np.unique(tail, return_index=True, return_counts=True)[1:]
    of = np.repeat(np.arange(len(first)), degree)
    # With the clock from the edge back, the next edge keeps the face on the left.
    before = np.arange(len(tail)) - 1
    before[first] += degree
    following = before[twin]
    label = _least(np.arange(len(tail)), following)
    starts, face = np.unique(label, return_inverse=True)
    low = xy[tail[first]][of][starts][face]
    p, q = xy[tail] - low, xy[head] - low
    area = np.bincount(face, p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]) / 2
    owner, odd = _odd_faces(face, twin, area, area < 0)
    # Lines within other lines of the geometry: what lies around them counts too.
    groups = np.unique(owner[owner >= 0])
    of_group = shape[tail[starts[groups]]]
    around = np.zeros(len(area), bool)
    for g in np.flatnonzero(np.bincount(of_group, minlength=count) > 1):
        lines = np.flatnonzero(shape[tail] == g)
        lines = lines[tail[lines] < head[lines]]
        a, b, group = xy[tail[lines]], xy[head[lines]], owner[face[lines]]
        for k in groups[of_group == g]:
            spot, other = xy[tail[starts[k]]], group != k
            up = other & ((a[:, 1] > spot[1]) != (b[:, 1] > spot[1]))
            right = (orientation(a[up], b[up], spot[None]) > 0) == (b[up][:, 1] > a[up][:, 1]) if up.any() else up[:0]
            around[k] = right.sum() % 2 == 1
    filled = odd ^ around[owner]
    walks = np.argsort(_places(following, starts, face), kind="stable")
    bounds = np.searchsorted(face[walks], np.arange(len(area) + 1))
    holes: list[list[tuple[np.ndarray, int]]] = [[] for _ in range(count)]
    for k in np.flatnonzero(filled & (owner >= 0)):
        nodes = tail[walks[bounds[k] : bounds[k + 1]]].tolist()
        g = shape[nodes[0]]
        rings = [xy[[*r, r[0]]] for r in (_simple(nodes) if len(set(nodes)) < len(nodes) else [nodes])]
        shells = [r for r in rings if _area(r) > 0]
        if area[k] > 0:
            out[g].append([shells[0], *(r for r in rings if r is not shells[0])])
        else:
            holes[g] += [(r, owner[k]) for r in rings]
    for g, found in enumerate(holes):
        for hole, _ in found:
            around_it = [s for s in out[g] if _area(s[0]) > -_area(hole) and _side(hole, s[0]) > 0]
            if around_it:
                min(around_it, key=lambda s: _area(s[0])).append(hole)
    return out


def _places(following: np.ndarray, starts: np.ndarray, face: np.ndarray) -> np.ndarray:
    """A sort key that puts the edges of each face in the order of its walk."""
    n = len(following)
    # Steps from each edge to its face's first one, by doubling.
    end = np.zeros(n, bool)
    end[starts] = True
    steps, to = np.where(end, 0, 1), np.where(end, np.arange(n), following)
    while not end[to].all():
        steps, to = steps + steps[to], to[to]
    return face * (n + 1) + np.where(end, 0, n + 1 - steps)


def repaired(shapes: pa.Array) -> pa.Array:
    """Valid geometries of the same points by the even-odd rule; valid ones, and those without rules, stay as they are.

    Rings are closed, segments cut where they meet, and faces with an odd number of rings around them are the result; holes
    go to the smallest shell around them. Rings with coordinates that are no numbers are left out. What has no area is
    dropped; a polygon of none becomes an empty multipolygon."""
    kinds = shapes.field("type").to_pylist()
    found = problems(shapes)
    at = [i for i, x in enumerate(found) if x and kinds[i] in ("Polygon", "MultiPolygon")]
    if not at:
        return shapes
    packed = Packed.of(shapes.field("parts").take(pa.array(at)))
    bad = np.bincount(packed.ring_of()[~np.isfinite(packed.xy).all(1)], minlength=len(packed.points))
    packed = packed.keep((bad == 0) & (packed.points > 0)).closed().distinct()
    packed = packed.keep(packed.points > 2)
    a, b, ring, _ = packed.segments()
    faces = _faces(*_cut(a, b, packed.shape[ring]), len(at)) if len(a) else [[] for _ in at]
    rows = [{"type": "Polygon" if len(f) == 1 else "MultiPolygon", "parts": [[r.tolist() for r in part] for part in f]} for f in faces]
    both = pa.concat_arrays([shapes.cast(ARROW), pa.array(rows, ARROW)])
    index = np.arange(len(shapes))
    index[at] = len(shapes) + np.arange(len(at))
    return both.take(pa.array(index))


def problem(kind: str, parts) -> str | None:
    """Why one geometry is not valid."""
    return problems(_one(kind, parts))[0]


def repair(kind: str, parts) -> tuple[str, list]:
    """One geometry, repaired."""
    out = repaired(_one(kind, parts))[0].as_py()
    return out["type"], out["parts"]


def _one(kind: str, parts) -> pa.Array:
    return pa.array([{"type": kind, "parts": [[[[float(c) for c in p] for p in r] for r in part] for part in parts]}], ARROW)


@arrow_udf(StringType())
def _reason(shapes: pa.Array) -> pa.Array:
    return pa.array(problems(shapes), pa.string())


@arrow_udf(TYPE)
def _repaired(shapes: pa.Array) -> pa.Array:
    return repaired(shapes)


def invalid_reason(g: Column) -> Column:
    """Why a geometry is not valid; null for valid and null ones."""
    return _reason(g)


def is_valid(g: Column) -> Column:
    return F.when(g.isNotNull(), invalid_reason(g).isNull())


def make_valid(g: Column) -> Column:
    """A valid geometry of the same points; null for null."""
    return _repaired(g)
