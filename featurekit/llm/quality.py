"""Quality classifier (operator 3): random-indexing word vectors pooled per document, a two-layer numpy network, and a
temperature that calibrates its probabilities."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featurekit.llm.common import held_remainder, rows_that, slices

#: Bounds of the sample that the model is fitted on: labelled rows, and characters of a row (longer ones are not drawn).
FIT_ROWS = 4000
FIT_CHARS = 100_000
#: Length of word vectors, signs that an index vector has (8 bits of a hash say where each lies and which it is), words to
#: each side that are a word's context, and hidden units.
DIMENSIONS, SIGNS, WINDOW, HIDDEN = 128, 8, 2, 24
#: Times that the sample has a word whose context is learnt.
OFTEN = 3
#: Distinct words, and chunks between blanks, that a task remembers before it starts over; bounds its memory, never the result.
REMEMBERED = 100_000
BATCH = 256
_PARTS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_").findall


#: Stands for a chunk that repeats the one before it.
AGAIN = "<again>"


def parts(chunk: str) -> list[str]:
    """Tokens of what stands between blanks: words in lower case, with a mark of their case, digits, and single signs."""
    out = []
    for p in _PARTS(chunk):
        out.append("<number>" if p[0].isdigit() else p.lower())
        if len(p) > 1 and p.isupper():
            out.append("<capitals>")
    return out


def index_slots(found: list[str]) -> np.ndarray:
    """The signs of words' index vectors, which only the words' hashes decide: 2 * place, and 1 more for a minus."""
    raw = b"".join(xxhash.xxh3_128_digest(t.encode("utf-8", "replace")) for t in found)
    return np.frombuffer(raw, np.uint8).reshape(-1, 16)[:, :SIGNS]


def spread(slots: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The weighted sum of index vectors, each of length 1 or so."""
    both = np.bincount(slots.ravel(), np.repeat(weights, SIGNS), 2 * DIMENSIONS)
    return (both[::2] - both[1::2]) / np.sqrt(SIGNS)


def tokens(text: str) -> list[str]:
    """A text's tokens in order; a chunk that repeats the one before it is marked."""
    out, last = [], None
    for chunk in text.split():
        if chunk == last:
            out.append(AGAIN)
        out += parts(chunk)
        last = chunk
    return out


@dataclass
class Model:
    """Contexts of the words that have one (row 0 of ``contexts`` is of all others: nothing), the network and its
    temperature. Every word, known or not, has an index vector of its own besides."""

    ids: dict[str, int]
    contexts: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def __post_init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        """The words that this worker has met: where each one's chunk ends in ``rows`` and ``slots``."""
        self.known: dict[str, tuple[int, int]] = {}
        self.numbers: dict[str, int] = {}
        self.slots, self.rows = np.empty((0, SIGNS), np.uint8), np.empty(0, np.int64)

    def _learn(self, new: list[str]) -> None:
        self.slots = np.concatenate([self.slots, index_slots(new)])
        self.rows = np.concatenate([self.rows, np.array([self.ids.get(t, 0) for t in new], np.int64)])
        self.numbers.update(zip(new, range(len(self.numbers), len(self.numbers) + len(new)), strict=True))

    def _counted(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """By text the numbers of its words, and how often each occurs, in the whole text."""
        found = [(text or "").split() for text in texts]
        if len(self.numbers) > REMEMBERED or len(self.known) > REMEMBERED:
            self.forget()
        cut = {c: parts(c) for c in set().union(*found).difference(self.known)}
        if new := list({t for ts in cut.values() for t in ts}.union([AGAIN]).difference(self.numbers)):
            self._learn(new)
        self.known.update((c, tuple(map(self.numbers.__getitem__, ts))) for c, ts in cut.items())
        out = []
        for chunks in found:
            counts = Counter(chunks)
            each = [self.known[c] for c in counts]
            again = sum(map(eq, chunks, chunks[1:]))
            at = np.fromiter(chain(chain.from_iterable(each), [self.numbers[AGAIN]]), np.int64)
            n = np.append(np.repeat(np.fromiter(counts.values(), float, len(counts)), np.fromiter(map(len, each), np.int64, len(each))), again)
            out.append((at, n))
        return out

    def pooled(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), DIMENSIONS))
        for row, (at, n) in zip(out, self._counted(texts), strict=True):
            n = n / max(n.sum(), 1)
            row += spread(self.slots[at], n)
            row += np.bincount(self.rows[at], n, len(self.contexts)) @ self.contexts if len(at) > len(self.contexts) else n @ self.contexts[self.rows[at]]
        return ((out - self.mean) / self.scale).astype(np.float32)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(self.pooled(texts)) / self.temperature, -30, 30).astype(np.float64)))


def contexts(sequences: Iterable[list[str]]) -> tuple[dict[str, int], np.ndarray]:
    """Of each word that occurs ``OFTEN`` times the sum of the index vectors around its places, brought to length 1. A
    sequence is held as numbers of its words, and sums are of whole numbers, so that no order of theirs matters."""
    number: dict[str, int] = {}
    numbered = [np.fromiter((number.setdefault(t, len(number)) for t in s), np.int32) for s in sequences]
    names, slots = list(number), np.empty((len(number), SIGNS), np.uint8)
    del number
    for part in range(0, len(names), 10_000):
        slots[part : part + 10_000] = index_slots(names[part : part + 10_000])
    counts = np.zeros(len(names), np.int64)
    for at in numbered:
        np.add.at(counts, at, 1)
    often = sorted(np.flatnonzero(counts >= OFTEN).tolist(), key=lambda i: (-counts[i], names[i]))
    row = np.zeros(len(names), np.int64)
    row[often] = np.arange(1, len(often) + 1)
    ids = {names[i]: k for k, i in enumerate(often, 1)}
    words = len(names)
    del names
    # Row 0 stays empty.
    made = np.zeros((len(often) + 1, DIMENSIONS), np.float32)
    for part in range(0, len(numbered), 250):
        chunk = numbered[part : part + 250]
        at = np.concatenate(chunk).astype(np.int64)
        doc = np.repeat(np.arange(len(chunk)), [len(s) for s in chunk])
        pairs = []
        for d in range(1, WINDOW + 1):
            x = np.flatnonzero(doc[:-d] == doc[d:])
            for word, near in ((at[x], at[x + d]), (at[x + d], at[x])):
                learnt = row[word] > 0
                pairs.append(word[learnt] * words + near[learnt])
        codes, n = np.unique(np.concatenate(pairs), return_counts=True)
        word, near = np.divmod(codes, max(words, 1))
        place = row[word] * DIMENSIONS
        for k in range(SIGNS):
            slot = slots[near, k]
            np.add.at(made.reshape(-1), place + (slot >> 1), np.where(slot & 1, -n, n).astype(np.float32))
    for part in range(0, len(made), 4096):
        block = made[part : part + 4096]
        block /= np.maximum(np.linalg.norm(block, axis=1, keepdims=True), 1e-9)
    return ids, made


def fit(texts: list[str], labels: list[int], seed: int = 11, steps: int = 400) -> Model | None:
    """A model of labelled texts; None where only one label occurs."""
    y = np.array(labels, np.float32)
    if len(set(labels)) < 2:
        return None
    ids, vectors = contexts(map(tokens, texts))
    rng = np.random.default_rng(seed)
    one, zero = np.ones(DIMENSIONS, np.float32), np.zeros(DIMENSIONS, np.float32)
    m = Model(ids, vectors, zero, one, rng.normal(0, DIMENSIONS**-0.5, (DIMENSIONS, HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32), rng.normal(0, HIDDEN**-0.5, HIDDEN).astype(np.float32), 0.0)
    x = np.concatenate([m.pooled(texts[i : i + 100]) for i in range(0, len(texts), 100)])
    m.mean, m.scale = x.mean(0), x.std(0) + 1e-3
    x = (x - m.mean) / m.scale
    order = rng.permutation(len(x))
    cut = max(1, len(x) // 5)
    held, train = order[:cut], order[cut:]
    if len(set(y[train].tolist())) < 2:
        train = order
    params = [m.w1, m.b1, m.w2, np.zeros(1, np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        batch = train if len(train) <= 512 else rng.choice(train, 512, replace=False)
        h = np.tanh(x[batch] @ params[0] + params[1])
        p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -30, 30)))
        e = (p - y[batch]) / len(batch)
        dh = np.outer(e, params[2]) * (1 - h * h)
        grads = [x[batch].T @ dh + 1e-4 * params[0], dh.sum(0), h.T @ e + 1e-4 * params[2], np.array([e.sum()])]
        for k, g in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            params[k] -= (0.01 * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    m.w1, m.b1, m.w2, m.b2 = params[0], params[1], params[2], float(params[3][0])
    z = m.logits(x[held]).astype(np.float64)
    loss = lambda t: np.logaddexp(0, np.where(y[held] > 0, -z, z) / t).mean()
    m.temperature = min(np.exp(np.linspace(-1.5, 3, 91)), key=loss)
    m.forget()
    return m


def training_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int, chars: int) -> DataFrame:
    """At most ``rows`` labelled documents (doc_id, text, y), those of smallest hash of the id; ``learn`` says which rows
    of labels may be learnt from. Null labels, ids and texts are left out; of contradicting labels the larger holds."""
    known = labels.filter(learn & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", "text").filter(F.length("text") <= chars)
    return found.join(F.broadcast(drawn), "doc_id").dropDuplicates(["doc_id"])  # ``rows`` pairs of numbers at most


def score(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of documents.

    The model is fitted on at most ``rows`` labelled rows that are not held out (crc32 of the id modulo 5 is not 0) and of
    at most ``FIT_CHARS`` characters; it then scores every whole text. Null and empty texts have the score of a text
    without words. Without two labels to learn from, every score is 0.5. A null id counts as held out. Repeated rows
    each have their score; other columns are not read, and there is no shuffle of documents."""
    shared = _fitted(docs, labels, rows)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, BATCH):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_scores(shared.value, b.column(1).to_pylist()))], names=["doc_id", "score"])
        if shared.value:
            shared.value.forget()

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    held = F.coalesce(held_remainder("doc_id", 5) == 0, F.lit(True))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _fitted(docs: DataFrame, labels: DataFrame, rows: int) -> Broadcast:
    sample = training_sample(docs, labels, "quality", held_remainder("doc_id", 5) != 0, rows, FIT_CHARS).orderBy("doc_id").collect()
    return docs.sparkSession.sparkContext.broadcast(fit([r["text"] for r in sample], [r["y"] for r in sample]))


def _scores(model: Model | None, texts: list[str | None]) -> np.ndarray:
    return model.scores(texts) if model else np.full(len(texts), 0.5)


def passing(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, threshold: float = 0.3) -> DataFrame:
    """The rows whose score reaches the threshold, as they were. Each row is judged by its own text, whatever its id, as it
    passes; there is no shuffle of documents."""
    shared = _fitted(docs, labels, rows)
    return rows_that(docs, "text", lambda: lambda texts: (_scores(shared.value, texts) >= threshold).tolist(), BATCH, lambda: shared.value and shared.value.forget())
