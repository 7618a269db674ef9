"""Toxicity (operator 8): nearest labelled examples by the exact cosine of whole TF-IDF vectors; votes weighted by
distance give calibrated scores and evidence."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property, partial
from itertools import chain, islice, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featurekit.llm.common import held_remainder, materialize, rows_that, slices
from featurekit.llm.quality import training_sample

#: Bounds of the sample of labelled rows that are the examples.
FIT_ROWS = 12_000
FIT_CHARS = 100_000
NEIGHBOURS = 15
#: Letters of a word's beginning that stand for the forms of its stem.
STEM = 5
#: Examples of a block, blocks of a group, and the terms of most examples, that many at most, whose weights a group keeps side
#: by side where that many of its examples have them.
BLOCK = 32
GROUP = 16
DENSE = 4096
SHARED = 32
#: Commonest terms, kinds and rounds by which like examples are told.
LEADS, KINDS, ROUNDS = 256, 8, 8
#: Groups that a text meets before its bar is raised, and texts whose candidates are verified at once.
FIRST = 1
ABREAST = 32
#: Entries of lists that are added up at once, but for one list more.
HELD = 1 << 15
#: More than what single precision may be wrong by.
SLACK = 1e-5
#: Words of evidence of a text.
EVIDENCE = 10
REMEMBERED = 150_000
BATCH = 256
_WORDS = re.compile(r"[^\W\d_]+").findall
#: The first 256 characters with a blank for each that belongs to no word.
_LETTERS = "".join(c if _WORDS(c) else " " for c in map(chr, range(256))).encode("latin-1")


def words(text: str | None) -> list[str]:
    low = (text or "").lower()
    try:
        return low.encode("latin-1").translate(_LETTERS).decode("latin-1").split()
    except UnicodeEncodeError:
        return _WORDS(low)


def terms(word: str) -> list[str]:
    """The word and, where it is long enough, its first ``STEM`` letters."""
    return [word, f"{word[:STEM]}-"] if len(word) >= STEM else [word]


def hashed(found: Iterable[str]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(t.encode("utf-8", "replace")) for t in found], np.uint64)


class Vocabulary:
    """Numbers of terms, known by their hashes (ascending)."""

    def __init__(self, hashes: np.ndarray, numbers: np.ndarray):
        self.hashes, self.numbers = hashes, numbers

    def numbered(self, found: list[str]) -> np.ndarray:
        """By term its number, or -1."""
        h = hashed(found)
        order = np.argsort(h)  # lookups in order meet what lies near the last one
        at = np.empty(len(h), np.int64)
        at[order] = np.minimum(np.searchsorted(self.hashes, h[order]), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.numbers[at], -1) if len(self.hashes) else np.full(len(h), -1)

    def get(self, term: str) -> int | None:
        n = int(self.numbered([term])[0])
        return n if n >= 0 else None

    __getitem__ = get


@dataclass
class Index:
    """Examples as TF-IDF vectors of length 1 over all their terms: of example e the terms and their counts from ``ptr[e]``
    to ``ptr[e + 1]``. Terms are numbered from the commonest on, so that what is often asked for lies together. ``idf`` also
    holds how much more often than others toxic examples have a term. What searching needs beyond that is made where it is
    first asked for."""

    ids: Vocabulary
    idf: np.ndarray
    labels: np.ndarray
    examples: list
    ptr: np.ndarray
    terms: np.ndarray
    counts: np.ndarray

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        t = np.array(sorted(counts), np.int64)
        return self.weighed(t, np.array([counts[i] for i in t.tolist()], float))

    def weighed(self, t: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(n)) * self.idf[t]
        return t, w / max(np.linalg.norm(w), 1e-12)

    def raw(self, begin: int, end: int) -> np.ndarray:
        """Weights of the entries from ``begin`` to ``end``, before the vectors are brought to length 1."""
        return (1 + np.log(self.counts[begin:end], dtype=np.float64)) * self.idf[self.terms[begin:end]]

    @cached_property
    def logs(self) -> np.ndarray:
        """What a count weighs, by the count."""
        return np.append(0.0, 1 + np.log(np.arange(1, int(self.counts.max(initial=0)) + 1, dtype=np.float64)))

    def stretches(self) -> Iterator[tuple[int, slice, np.ndarray]]:
        """Some examples at a time: the first one, where their entries lie, and of which of them each entry is."""
        for e in range(0, len(self.labels), BATCH):
            n = np.diff(self.ptr[e : e + BATCH + 1])
            yield e, slice(self.ptr[e], self.ptr[e] + n.sum()), np.repeat(np.arange(len(n)), n)

    @cached_property
    def lengths(self) -> np.ndarray:
        squares = [np.bincount(of, self.raw(at.start, at.stop) ** 2, min(BATCH, len(self.labels) - e)) for e, at, of in self.stretches()]
        return np.maximum(np.sqrt(np.concatenate([self.idf[:0], *squares])), 1e-12)

    def example(self, e: int) -> tuple[np.ndarray, np.ndarray]:
        begin, end = self.ptr[e], self.ptr[e + 1]
        return self.terms[begin:end], self.raw(begin, end) / self.lengths[e]

    @cached_property
    def lists(self) -> "Lists":
        return Lists(self)

    def search(self, vectors: list[tuple[np.ndarray, np.ndarray]], without: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By vector the cosines and numbers of the examples of largest cosine above 0, exactly, ties to the smaller
        number; and how much each of its terms adds to these cosines, which weigh as in the vote."""
        out = []
        place = np.full(len(self.idf), -1, np.int32)
        found = self.lists.candidates(vectors, without)
        for a in range(0, len(vectors), ABREAST):
            out += self._verified(vectors[a : a + ABREAST], found[a : a + ABREAST], place)
        return out

    def _verified(self, vectors: list[tuple[np.ndarray, np.ndarray]], found: list[np.ndarray], place: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        best, size = np.concatenate(found), np.array([len(x) for x in found])
        text = np.repeat(np.arange(len(found)), size)
        begin, end = self.ptr[best], self.ptr[best + 1]
        spans = list(map(slice, begin.tolist(), end.tolist()))
        ends, terms = np.cumsum([0, *size]), np.cumsum([0, *(len(t) for t, _ in vectors)]).tolist()
        at = [place[:0]]
        for (t, _), (a, b), (x, y) in zip(vectors, pairwise(ends.tolist()), pairwise(terms), strict=True):
            # Where an example's term stands in the vectors; met are those that the text has.
            place[t] = np.arange(x, y, dtype=np.int32)
            at.append(place[np.concatenate([self.terms[:0], *map(self.terms.__getitem__, spans[a:b])])])
            place[t] = -1
        at = np.concatenate(at)
        met = np.flatnonzero(at >= 0)
        at, which = at[met], np.repeat(np.arange(len(best)), end - begin)[met]
        counts = np.concatenate([self.counts[:0], *map(self.counts.__getitem__, spans)])[met]
        part = np.concatenate([w * self.idf[t] for t, w in vectors])[at] * self.logs[counts]
        cosine = (np.bincount(which, part, len(best)) / self.lengths[best]).round(9)
        order = np.lexsort((best, -cosine, text))
        first = order[(np.arange(len(best)) - ends[text] < NEIGHBOURS) & (cosine[order] > 0)]
        gain = np.zeros(len(best))
        gain[first] = 1 / (1.05 - cosine[first]) / self.lengths[best[first]]
        shares = np.bincount(at, part * gain[which], terms[-1])
        cuts = np.searchsorted(text[first], np.arange(len(found) + 1)).tolist()
        cosine, best = cosine[first], best[first]
        return [(cosine[a:b], best[a:b], shares[x:y]) for (a, b), (x, y) in zip(pairwise(cuts), pairwise(terms), strict=True)]

    def nearest(self, counts: dict[int, int]) -> list[tuple[float, int]]:
        cosine, best, _ = self.search([self.vector(counts)])[0]
        return list(zip(cosine.tolist(), best.tolist(), strict=True))

    def vote(self, cosine: np.ndarray, best: np.ndarray) -> float:
        """Share of toxic examples, each weighing as much as it is near."""
        w = 1 / (1.05 - cosine)
        return float((w @ self.labels[best]) / w.sum())

    def own_votes(self, numbers: list[int]) -> list[float | None]:
        """Votes on examples by the others; None without a neighbour."""
        vectors = [self.example(e) for e in numbers]
        return [self.vote(c, best) if len(best) else None for c, best, _ in self.search(vectors, numbers)]

    def rates(self, votes: list[float | None]) -> tuple[float, float, float]:
        """a and b of the calibration, and the share of toxic examples among those without a neighbour."""
        met = np.array([v is not None for v in votes])
        bare = (self.labels[~met].sum() + self.labels.mean()) / ((~met).sum() + 1)
        return *_platt(np.array([v for v in votes if v is not None]), self.labels[met]), float(bare)


class Lists:
    """Block-max inverted lists. Examples lie in blocks of ``BLOCK``, like ones together, and in groups of ``GROUP`` blocks. Of
    each term that is common in a group, the group has all weights and the largest of each block; the examples of any other
    term are listed.

    A text's cosine with an example is at most the block's largest weights of the group's terms, times the text's, and
    the block's largest sum over the lists. Groups are opened from the highest bound on, until the bound of those
    that are left lies below the ``NEIGHBOURS``-th best cosine."""

    def __init__(self, index: Index):
        n, width, size = len(index.labels), BLOCK * GROUP, min(DENSE, len(index.idf))
        # Like ones: with like weights of the commonest terms (texts of one language, mostly), of the same label, and with most
        # weight on the same one of these terms.
        table = np.zeros((n, max(min(LEADS, size), 1)), np.float32)
        for e, at, of in index.stretches():
            t = index.terms[at]
            some = np.flatnonzero(t < table.shape[1])
            table[e + of[some], t[some]] = index.raw(at.start, at.stop)[some] / index.lengths[e + of[some]]
        order = np.lexsort((table.max(1), table.argmax(1), index.labels, _kinds(table)))
        self.groups, self.common = -(-n // width), size
        self.number = np.full(self.groups * width, -1)
        self.number[:n] = order
        self.place = np.empty(n, np.int32)
        self.place[order] = np.arange(n)
        had = np.zeros(self.groups * size, np.int64)
        for e, at, of in index.stretches():
            t = index.terms[at]
            some = np.flatnonzero(t < size)
            had += np.bincount(self.place[e + of[some]] // width * size + t[some], minlength=len(had))
        had = had.reshape(self.groups, size)
        own = had >= SHARED
        self.terms = [np.flatnonzero(x) for x in own]
        room = np.cumsum([0, *(len(x) * width for x in self.terms)])
        weights = np.zeros(room[-1], np.float32)
        self.weights = [weights[a:b].reshape(-1, width) for a, b in pairwise(room.tolist())]
        row = np.where(own, own.cumsum(1) - 1, -1)
        df = np.bincount(index.terms, minlength=len(index.idf))
        df[:size] -= np.where(own, had, 0).sum(0)
        start = np.concatenate([[0], np.cumsum(df)])
        self.listed = np.empty(start[-1], np.min_scalar_type(self.groups * width))
        counts = np.empty(start[-1], index.counts.dtype)
        free = start[:-1].copy()
        for e, at, of in index.stretches():
            t, place = index.terms[at], self.place[e + of]
            w = index.raw(at.start, at.stop) / index.lengths[e + of]
            own = np.where(t < size, row[place // width, np.minimum(t, size - 1)], -1)
            some = np.flatnonzero(own >= 0)
            weights[room[place[some] // width] + own[some] * width + place[some] % width] = w[some]
            some = np.flatnonzero(own < 0)
            some = some[np.argsort(t[some], kind="stable")]
            t = t[some]
            head = np.flatnonzero(np.append(True, t[1:] != t[:-1])[: len(t)])
            n_each = np.diff(np.append(head, len(t)))
            into = free[t] + np.arange(len(t)) - np.repeat(head, n_each)
            self.listed[into], counts[into] = place[some], index.counts[at][some]
            free[t[head]] += n_each
        self.most = [x.reshape(len(x), GROUP, BLOCK).max(2) for x in self.weights]
        # Runs: stretches of a list whose examples have the term equally often, and so weigh the same but for their lengths.
        heads, repeats = [], []
        cuts = np.unique(np.append(np.searchsorted(start, np.arange(0, start[-1], 1 << 18)), len(df)))
        for a, b in pairwise(cuts.tolist()):
            some = slice(start[a], start[b])
            t, c = np.repeat(np.arange(a, b), df[a:b]), counts[some]
            order = np.argsort((t - a) * (int(c.max(initial=0)) + 1) + c)
            self.listed[some], c = self.listed[some][order], c[order]
            head = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (c[1:] != c[:-1]))[: len(t)])
            heads.append(head + start[a])
            repeats.append(c[head])
        self.begin = np.concatenate([*heads, start[-1:]])
        self.repeats = np.concatenate([counts[:0], *repeats])
        self.runs = np.searchsorted(self.begin, start)
        self.idf, self.logs = index.idf, index.logs
        self.share = np.zeros(self.groups * width)
        self.share[self.place] = 1 / index.lengths

    def _runs(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By vector where the runs of its terms begin and end, and what each adds to its examples, but for their lengths."""
        for some in (vectors[a : a + ABREAST] for a in range(0, len(vectors), ABREAST)):
            t = np.concatenate([t for t, _ in some])
            first, many = self.runs[t], self.runs[t + 1] - self.runs[t]
            ends = np.cumsum(many)
            run = np.repeat(first - ends + many, many) + np.arange(many.sum())
            w = np.repeat(np.concatenate([w for _, w in some]) * self.idf[t], many) * self.logs[self.repeats[run]]
            begin, end = self.begin[run], self.begin[run + 1]
            cuts = np.append(0, ends)[np.cumsum([0, *(len(t) for t, _ in some)])].tolist()
            yield from ((begin[a:b], end[a:b], w[a:b]) for a, b in pairwise(cuts))

    def _listed(self, begin: np.ndarray, end: np.ndarray, w: np.ndarray, room: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """What runs add to each example's cosine. Large arrays lie in ``room``, since memory that is new each time costs more
        than what is done in it."""
        so_far = np.cumsum(end - begin)
        out = np.zeros(len(self.share))
        cuts = np.searchsorted(so_far, np.arange(HELD, so_far[-1], HELD)) + 1 if len(w) else []
        for a, b in pairwise([0, *cuts, len(w)]):
            if b > a:
                n = end[a:b] - begin[a:b]
                at, place = (x[: int(n.sum())] for x in room)
                at.fill(1)
                at[0] = begin[a]
                at[np.cumsum(n[:-1])] = begin[a + 1 : b] - end[a : b - 1] + 1
                np.cumsum(at, out=at)
                self.listed.take(at, out=place, mode="clip")
                out += np.bincount(place, np.repeat(w[a:b], n), len(out))
        return out * self.share

    def candidates(self, vectors: list[tuple[np.ndarray, np.ndarray]], without: list[int] | None) -> list[np.ndarray]:
        """By vector the examples that may be among the nearest; never ``without``'s."""
        width = BLOCK * GROUP
        queries = np.zeros((self.common, len(vectors)), np.float32)
        near = np.zeros((len(vectors), self.groups * width), np.float32)
        room = tuple(np.empty(HELD + int(np.diff(self.begin).max(initial=0)), k) for k in (np.int64, self.listed.dtype))
        for q, ((t, w), runs) in enumerate(zip(vectors, self._runs(vectors), strict=True)):
            common = t < self.common
            queries[t[common], q] = w[common]
            near[q] = self._listed(*runs, room)
        if without is not None:
            near[np.arange(len(vectors)), self.place[without]] = -2
        near = near.reshape(len(vectors), self.groups, width)
        bound = near.reshape(len(vectors), self.groups, GROUP, BLOCK).max(3)
        for g, (terms, most) in enumerate(zip(self.terms, self.most, strict=True)):
            bound[:, g] += queries[terms].T @ most
        bound = bound.max(2) + SLACK
        opened = np.zeros(bound.shape, bool)
        bar = np.full(len(vectors), SLACK)
        for at_once in (FIRST, self.groups):
            wanted = np.where(opened | (bound < bar[:, None]), 0, bound)
            if at_once < self.groups:
                wanted[wanted < np.partition(wanted, -at_once, 1)[:, -at_once, None]] = 0
            for g in np.flatnonzero(wanted.any(0)).tolist():
                of = np.flatnonzero(wanted[:, g])
                near[of, g] += queries[self.terms[g]].take(of, 1).T @ self.weights[g]
            opened |= wanted > 0
            if at_once < self.groups:
                for q, (o, s) in enumerate(zip(opened, near, strict=True)):
                    found = s[o].ravel()
                    if len(found) > NEIGHBOURS:
                        bar[q] = max(bar[q], np.partition(found, -NEIGHBOURS)[-NEIGHBOURS] - SLACK)
        out = []
        for o, s, least in zip(opened, near, bar, strict=True):
            g = np.flatnonzero(o)
            found = s[g].ravel()
            at = np.flatnonzero(found >= least - SLACK)
            if len(at) > NEIGHBOURS:
                found = found[at]
                at = at[found >= np.partition(found, -NEIGHBOURS)[-NEIGHBOURS] - 2 * SLACK]
            out.append(np.sort(self.number[g[at // width] * width + at % width]))
        return [x[x >= 0] for x in out]


def _kinds(table: np.ndarray) -> np.ndarray:
    """By row the number of its kind, of ``KINDS`` or fewer, numbered so that kinds that follow each other are alike. A kind
    begins as the rows whose largest value is in the same column, one of those of most such rows, and then takes what is
    nearest to its mean."""
    lead = table.argmax(1)
    seeds = np.argsort(-np.bincount(lead, minlength=table.shape[1]), kind="stable")[:KINDS]
    member = lead[:, None] == seeds
    for _ in range(ROUNDS):
        mean = member.T.astype(np.float32) @ table
        mean /= np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)
        member = (table @ mean.T).argmax(1)[:, None] == np.arange(len(seeds))
    like = mean @ mean.T
    chain_of = [int(member.sum(0).argmax())]
    while len(chain_of) < len(seeds):
        rest = like[chain_of[-1]].copy()
        rest[chain_of] = -1
        chain_of.append(int(rest.argmax()))
    return np.argsort(chain_of)[member.argmax(1)]


def _logit(p):
    p = np.clip(p, 0.01, 0.99)
    return np.log(p / (1 - p))


def assemble(rows: list[tuple[object, int, np.ndarray, np.ndarray]]) -> Index | None:
    """An index of (id, label, hashes of terms, their counts). A term weighs its idf, times how many times as often as in
    all examples the label occurs among those with the term, 1 at least (two more examples with the usual share count
    along): a ratio, which does not grow with the examples."""
    labels = np.array([r[1] for r in rows], float)
    if len(set(labels.tolist())) < 2:
        return None
    known = np.empty(0, np.uint64)
    for e in range(0, len(rows), 1000):
        known = np.unique(np.concatenate([known, *(r[2] for r in rows[e : e + 1000])]))
    ptr = np.cumsum([0, *(len(r[2]) for r in rows)])
    most = max((int(r[3].max(initial=1)) for r in rows), default=1)
    terms, counts = np.empty(ptr[-1], np.int32), np.empty(ptr[-1], np.min_scalar_type(most))
    for e, (_, _, h, n) in enumerate(rows):
        order = np.argsort(h)
        terms[ptr[e] : ptr[e + 1]], counts[ptr[e] : ptr[e + 1]] = np.searchsorted(known, h[order]), n[order]
    df, both = np.zeros(len(known), np.int64), np.zeros(len(known))
    for e in range(0, len(rows), 500):
        some = slice(e, e + 500)
        part = terms[ptr[e] : ptr[min(e + 500, len(rows))]]
        df += np.bincount(part, minlength=len(known))
        both += np.bincount(part, np.repeat(labels[some], np.diff(ptr)[some]), len(known))
    lift = (both / labels.mean() + 2) / (df + 2)
    idf = (np.log((1 + len(rows)) / (1 + df)) + 1) * np.maximum(lift, 1)
    order = np.argsort(-df, kind="stable")
    numbers = np.empty(len(known), np.int32)
    numbers[order] = np.arange(len(known))
    for begin in range(0, len(terms), HELD):
        terms[begin : begin + HELD] = numbers[terms[begin : begin + HELD]]
    return Index(Vocabulary(known, numbers), idf[order], labels, [r[0] for r in rows], ptr, terms, counts)


def build(examples: list[tuple[object, int, dict[str, int]]], df: dict[str, int], n: int) -> Index | None:
    """An index of (id, label, counts of terms); df: in how many of the n examples a term occurs."""
    return assemble([(i, y, hashed(c), np.array(list(c.values()), np.int32)) for i, y, c in examples])


def term_counts(text: str | None) -> Counter:
    out: Counter = Counter()
    for w, n in Counter(words(text)).items():
        for t in terms(w):
            out[t] += n
    return out


def _platt(votes: np.ndarray, truth: np.ndarray) -> tuple[float, float]:
    """a and b of a logistic curve over the votes' log-odds, of which examples' votes without themselves are the data."""
    if not len(votes):
        return 1.0, 0.0
    pos, neg = truth.sum(), (1 - truth).sum()
    target = np.where(truth > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([_logit(votes), np.ones(len(votes))], 1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-2, 1e-2])
        w = w - np.linalg.solve(hessian, x.T @ (p - target) + 1e-2 * (w - [1.0, 0.0]))
    return float(max(w[0], 0.1)), float(w[1])


def learn(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Index | None:
    """The index of at most ``rows`` labelled documents, over all their words and stems. Tasks count and hash the terms, so
    that the driver holds two numbers by example and term."""
    sample = training_sample(docs, labels, "toxic", held_remainder("doc_id", 3) != 1, rows, FIT_CHARS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, BATCH):
            found = [term_counts(t) for t in b.column(1).to_pylist()]
            h, n = [hashed(c).tobytes() for c in found], [np.array(list(c.values()), np.int32).tobytes() for c in found]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(h, pa.binary()), pa.array(n, pa.binary())], names=["doc_id", "y", "h", "n"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = materialize(sample.select("doc_id", "text", "y").repartition(8).mapInArrow(count, f"doc_id {kind}, y int, h binary, n binary"))
    small = lambda n: n.astype(np.min_scalar_type(int(n.max(initial=1))))
    found = [(r["doc_id"], r["y"], np.frombuffer(bytes(r["h"]), np.uint64), small(np.frombuffer(bytes(r["n"]), np.int32))) for r in counted.toLocalIterator()]  # rows of the bounded sample
    found.sort(key=lambda r: r[0])
    return assemble(found)


class Numbers(dict):
    """Numbers of words, in the order in which they are met."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Scorer:
    """Scores of texts; the terms of words that were met before are remembered, within bounds."""

    def __init__(self, index: Index, rates: tuple[float, float, float]):
        self.index, self.rates = index, rates
        self.forget()

    def forget(self) -> None:
        self.known, self.stems = Numbers(), Numbers()
        # By word its own term and its stem's number (-1: none), by stem its term (-1: unknown).
        self.own, self.stem, self.stem_terms = (np.empty(0, np.int64) for _ in range(3))

    def _numbers(self, found: list[Counter]) -> np.ndarray:
        """The numbers of the texts' distinct words, of which ``own`` and ``stem`` lead to the terms."""
        if len(self.known) > REMEMBERED:
            self.forget()
        begin, stems = len(self.known), len(self.stems)
        out = np.fromiter(map(self.known.__getitem__, chain.from_iterable(found)), np.int64, sum(map(len, found)))
        new = list(islice(reversed(self.known), len(self.known) - begin))[::-1]
        stem = np.fromiter((self.stems[w[:STEM]] if len(w) >= STEM else -1 for w in new), np.int64, len(new))
        new_stems = list(islice(reversed(self.stems), len(self.stems) - stems))[::-1]
        numbered = self.index.ids.numbered
        self.own, self.stem = np.append(self.own, numbered(new)), np.append(self.stem, stem)
        self.stem_terms = np.append(self.stem_terms, numbered([f"{x}-" for x in new_stems]))
        return out

    def __call__(self, texts: list[str | None]) -> list[tuple[float, list[int], list[str]]]:
        index, (a, b, bare) = self.index, self.rates
        found = [Counter(words(t)) for t in texts]
        # One entry for each distinct word of a text, and as many after these for their stems.
        k, ends = self._numbers(found), np.cumsum([0, *map(len, found)])
        text = np.repeat(np.arange(len(texts)), np.diff(ends))
        stem = self.stem[k]
        ids = np.concatenate([self.own[k], np.where(stem >= 0, self.stem_terms[stem], -1) if len(self.stem_terms) else stem])
        at = np.flatnonzero(ids >= 0)
        entry = at % max(len(k), 1)
        keys, part = np.unique(text[entry] * len(index.idf) + ids[at], return_inverse=True)
        of, t = np.divmod(keys, max(len(index.idf), 1))
        n = np.fromiter(chain.from_iterable(c.values() for c in found), float, len(k))
        w = (1 + np.log(np.bincount(part, n[entry], len(keys)))) * index.idf[t]
        w /= np.maximum(np.sqrt(np.bincount(of, w * w, len(texts))), 1e-12)[of]
        near = index.search([(t[x:y], w[x:y]) for x, y in pairwise(np.searchsorted(of, np.arange(len(texts) + 1)).tolist())])
        weight = np.bincount(entry, np.concatenate([w[:0], *(shares for _, _, shares in near)])[part], len(k))
        out = []
        for c, (x, y), (cosine, best, _) in zip(found, pairwise(ends.tolist()), near, strict=True):
            if not len(best):
                out.append((bare, [], []))
                continue
            p = float(1 / (1 + np.exp(-np.clip(a * _logit(index.vote(cosine, best)) + b, -30, 30))))
            first = np.argsort(-weight[x:y], kind="stable")[:EVIDENCE]
            names = list(c)
            out.append((p, best.tolist(), sorted(names[i] for i in first.tolist() if weight[x + i] > 0)))
        return out


def _calibrated(spark: SparkSession, shared: Broadcast, index: Index | None) -> tuple[float, float, float]:
    """Rates from the votes on each example by the others, which tasks count."""
    if index is None:
        return 1.0, 0.0, 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, BATCH):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.own_votes(b.column(0).to_pylist()), pa.float64())], names=["e", "vote"])

    rows = spark.range(0, len(index.labels), 1, 12).mapInArrow(run, "e bigint, vote double").collect()  # two numbers by example
    return index.rates([r["vote"] for r in sorted(rows, key=lambda r: r["e"])])


def _fitted(docs: DataFrame, labels: DataFrame, rows: int) -> Callable[[], tuple[Callable, list]]:
    """What a task calls for a function from texts to (score, examples, words of evidence), and the examples' ids."""
    index = learn(docs, labels, rows)
    shared = docs.sparkSession.sparkContext.broadcast(index)
    rates = _calibrated(docs.sparkSession, shared, index)

    def scorer() -> tuple[Callable, list]:
        known = shared.value
        return (Scorer(known, rates), known.examples) if known else (lambda texts: [(0.0, [], [])] * len(texts), [])

    return scorer


def score(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, neighbours (ids of the nearest examples) and evidence (the ``EVIDENCE`` words
    that add most to their cosines) of every row of documents.

    Examples are at most ``rows`` labelled rows that are not held out (crc32 of the id modulo 3 is not 1) and of at most
    ``FIT_CHARS`` characters; every whole text is compared with all of them, exactly, by all its terms. Texts without
    any word of an example, null and empty ones among them, have the share of toxic examples among such examples. Without
    two labels to learn from, every score is 0. A null id counts as held out. Repeated rows each have their score; other
    columns are not read, and there is no shuffle of documents."""
    fitted = _fitted(docs, labels, rows)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score_of, ids = fitted()
        for b in slices(batches, BATCH):
            got = score_of(b.column(1).to_pylist())
            near = pa.array([[ids[e] for e in x[1]] for x in got], pa.list_(b.schema.field(0).type))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in got], pa.float64()), near, pa.array([x[2] for x in got], pa.list_(pa.string()))], names=["doc_id", "score", "neighbours", "evidence"])

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, neighbours array<{kind}>, evidence array<string>")
    held = F.coalesce(held_remainder("doc_id", 3) == 1, F.lit(True))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "neighbours", "evidence")


def clean(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, threshold: float = 0.7) -> DataFrame:
    """The rows whose score stays below the threshold, as they were. Each row is judged by its own text, whatever its id,
    as it passes; there is no shuffle of documents."""
    fitted = _fitted(docs, labels, rows)

    def low(texts: list[str | None], score_of: Callable) -> list[bool]:
        return [x[0] < threshold for x in score_of(texts)]

    return rows_that(docs, "text", lambda: partial(low, score_of=fitted()[0]), BATCH)
