"""Benchmark decontamination (operator 9): spaced-seed hashes of test and training words meet, and the words around each
hit verify an overlap that tolerates substitutions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from featurekit.llm.common import materialize, window_hashes, word_hashes

#: Word positions that a seed compares. Each leaves out one residue of 3, 4, 5 or 6, so a substitution in every third to
#: sixth word leaves one of them whole at some place.
SEEDS = ((0, 1, 3, 4, 6, 7), (0, 1, 2, 4, 5, 6), (0, 1, 2, 3, 5, 6), (0, 1, 2, 3, 4, 6))
#: Further seeds for items of 8 to 15 words: together with the others they find every item of which 0.7 of the words are equal.
SHORT_SEEDS = ((0, 2, 3, 4), (0, 1, 2, 7), (0, 1, 5, 6), (0, 1, 3, 7))
#: Distinct seed hashes that are sent to every worker as such (32 MB); of more, a bitmap of FILTER_BITS bits (32 MB) is.
FILTER_KEYS, FILTER_BITS = 4_000_000, 1 << 28
#: Words of items that a row of places to verify carries, on average; rows of small tables that a join sends to every worker.
CARRIED, SMALL = 50_000, 200_000
BATCH = 256
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and all other characters beyond ASCII, A-Z lower-cased."""
    return text.encode("utf-8", "replace").translate(_TABLE).split() if text else []


def seeds_for(size: int, min_words: int) -> list[tuple[int, ...]]:
    """Word positions that each seed of an item of ``size`` words compares; items of fewer than 8 words have one of all."""
    if size < min_words:
        return []
    return [tuple(range(size))] if size < 8 else [*SEEDS, *SHORT_SEEDS] if size < 16 else [*SEEDS]


class Filter:
    """What every worker knows of the test seeds: all their hashes, sorted, or a bitmap of them."""

    def __init__(self, keys: np.ndarray | None, words: np.ndarray, shift: int, masks: list[tuple[int, ...]]):
        self.keys, self.words, self.shift, self.masks = keys, words, np.uint64(shift), masks

    def __call__(self, w: np.ndarray) -> np.ndarray:
        """Places of the hashes that may be, or (with all of them here) are, a test seed's."""
        at = w >> self.shift
        p = np.flatnonzero(self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1))
        if self.keys is None or not len(p):
            return p
        found = np.minimum(np.searchsorted(self.keys, w[p]), len(self.keys) - 1)
        return p[self.keys[found] == w[p]]


def _filter(seeds: DataFrame, masks: list[tuple[int, ...]]) -> Filter:
    """The driver gathers FILTER_KEYS hashes at most, or the words of a bitmap of FILTER_BITS bits."""
    n = seeds.count()
    bits = min(FILTER_BITS, max(1 << 16, 1 << (64 * n).bit_length()))
    shift = 64 - bits.bit_length() + 1
    if n <= FILTER_KEYS:
        keys = np.unique(np.array(seeds.select("h").toPandas()["h"], np.int64).view(np.uint64))
        words = np.zeros(bits // 64, np.uint64)
        at = keys >> np.uint64(shift)
        np.bitwise_or.at(words, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
        return Filter(keys, words, shift, masks)
    at = F.shiftrightunsigned("h", shift)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))
    found = seeds.groupBy(F.floor(at / 64).alias("w")).agg(F.bit_or(bit).alias("b")).toPandas()
    words = np.zeros(bits // 64, np.int64)
    words[found["w"].to_numpy()] = found["b"].to_numpy()
    return Filter(None, words.view(np.uint64), shift, masks)


def best_run(same: np.ndarray, min_share: float) -> tuple[int, int, int]:
    """Start, end and matches of the best stretch (the first, the longest of equal ones). A mismatch weighs so much that
    no stretch with a smaller share of matches than ``min_share`` is better than a part of it."""
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -min_share / (1 - min_share)).round(9))]).round(6)
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    start = int(np.flatnonzero(total[: end + 1] == low[end])[0])
    return start, end, int(same[start:end].sum())


def whole_run(same: np.ndarray, min_share: float) -> tuple[int, int, int]:
    """Start, end and matches of the stretch with most matches (the shortest, the first of equal ones) of those that have
    the share ``min_share`` and end where the overlap does: in no stretch that follows on it or leads to it do the matches
    outnumber the mismatches. So a copy of which too few words are equal does not count for a denser part of it."""
    n = np.concatenate([[0], np.cumsum(same)])
    at = np.arange(len(n))
    gain, total = 2 * n - at, (n - min_share * at).round(6)
    starts = np.flatnonzero(gain == np.minimum.accumulate(gain))
    ends = np.flatnonzero(gain == np.maximum.accumulate(gain[::-1])[::-1])
    # For each end the first start from which the share is reached: there the lowest total so far is no higher than at the end.
    first = np.searchsorted(-np.minimum.accumulate(total[starts]), -total[ends], "left")
    found = first < len(starts)
    a, b = starts[first[found]], ends[found]
    found = a < b
    if not found.any():
        return 0, 0, 0
    a, b = a[found], b[found]
    k = np.lexsort((a, b - a, n[a] - n[b]))[0]
    inner = np.flatnonzero(same[a[k] : b[k]])
    return int(a[k] + inner[0]), int(a[k] + inner[-1] + 1), len(inner)


def least_matches(size: int, min_matches: int, min_share: float) -> int:
    """Matches that an item of ``size`` words needs: ``min_matches``, or its share of them where that is less; those of
    fewer than 8 words, which one seed of all their words finds, need every word."""
    return min(min_matches, size if size < 8 else int(np.ceil(round(min_share * size, 6))))


def _items(tests: DataFrame) -> DataFrame:
    """Of texts: key (of the words), words (their hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [words_of(t) for t in b.column(1).to_pylist()]
            keys = [xxhash.xxh3_128_hexdigest(b" ".join(w)) for w in words]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys), pa.array([word_hashes(w).view(np.int64) for w in words], pa.list_(pa.int64()))], names=["item", "key", "words"])

    return tests.mapInArrow(run, StructType([tests.schema["item"], StructField("key", StringType()), StructField("words", ArrayType(LongType()))]))


def _seeds(items: DataFrame, min_words: int) -> DataFrame:
    """Of items (key, words): h, key and at, the place of every seed's first word in the item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, words in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                h = words.values.to_numpy().view(np.uint64)
                for offsets in seeds_for(len(h), min_words):
                    w = window_hashes(h, list(offsets))
                    yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array([key] * len(w)), pa.array(np.arange(len(w)))], names=["h", "key", "at"])

    return items.select("key", "words").mapInArrow(run, "h bigint, key string, at bigint")


def _hits(docs: DataFrame, shared: Broadcast) -> DataFrame:
    """Of documents (doc, text) with any hit: doc, words (their hashes), h and at (of each hit, in no order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for big in batches:
            for b in (big.slice(i, BATCH) for i in range(0, big.num_rows, BATCH)):
                words = [words_of(t) for t in b.column(1).to_pylist()]
                ends = np.cumsum([len(w) for w in words])
                h = word_hashes([x for w in words for x in w])
                doc = np.repeat(np.arange(len(words)), [len(w) for w in words])
                found, place = [], []
                for offsets in known.masks:
                    w = window_hashes(h, list(offsets))
                    p = known(w)
                    p = p[doc[p] == doc[p + offsets[-1]]]
                    found.append(w[p])
                    place.append(p)
                place = np.concatenate(place)
                order = np.argsort(doc[place], kind="stable")
                found, place = np.concatenate(found)[order], place[order]
                having, n = np.unique(doc[place], return_counts=True)
                begin = np.concatenate([[0], ends])[having]
                lists = lambda x, sizes: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(x))
                mine = np.isin(doc, having)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(having)), lists(h[mine].view(np.int64), ends[having] - begin), lists(found.view(np.int64), n), lists(place - np.repeat(begin, n), n)], names=["doc", "words", "h", "at"])

    many = ArrayType(LongType())
    return docs.mapInArrow(run, StructType([docs.schema["doc"], StructField("words", many), StructField("h", many), StructField("at", many)]))


def _verified(places: DataFrame, min_matches: int, min_share: float) -> DataFrame:
    """Of rows (row, words, found: key, start, item words) the overlaps: row, key, word_start, word_end, n_matched, n_item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row, words, cells in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                h, cells = words.values.to_numpy(), cells.values
                seen = set()
                for key, start, item in zip(cells.field(0).to_pylist(), cells.field(1).to_pylist(), cells.field(2), strict=True):
                    item = item.values.to_numpy()
                    lo, hi = max(start, 0), min(start + len(item), len(h))
                    same = h[lo:hi] == item[lo - start : hi - start]
                    least = least_matches(len(item), min_matches, min_share)
                    if same.sum() < least:
                        continue
                    a, e, n = max(best_run(same, min_share), whole_run(same, min_share), key=lambda x: x[2])
                    if n >= least and (key, lo + a) not in seen:
                        seen.add((key, lo + a))
                        out.append((row, key, lo + a, lo + e, n, len(item)))
            yield pa.RecordBatch.from_pydict(dict(zip(NAMES, zip(*out, strict=True), strict=True)) if out else {c: [] for c in NAMES}, schema=kinds)

    kinds = pa.schema([(c, pa.string() if c == "key" else pa.int64()) for c in NAMES])
    return places.select("row", "words", "found").mapInArrow(run, ", ".join(f"{c} {'string' if c == 'key' else 'bigint'}" for c in NAMES))


NAMES = ["row", "key", "word_start", "word_end", "n_matched", "n_item"]


def overlaps(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_matches: int = 12, min_share: float = 0.7, min_words: int = 5) -> DataFrame:
    """One row per document row, test item and place where they overlap: id, item, word_start, word_end (in the
    document), n_matched and share (of the item's words).

    A hit of any seed fixes how item and document lie on each other; on that diagonal the whole overlap, or the best
    stretch of equal words (``whole_run``, ``best_run``; of either at least ``min_share`` match), counts if it has
    ``min_matches`` matches, or ``min_share`` of the item's words where that is less; the place is that with more
    matches. Items of 5 to 7 words must occur whole; shorter or null ones match nothing, nor do empty or null texts.
    Items of equal words are searched once. Repeated rows give repeated results, and ids of any type, null ones too,
    stay as they are.

    Documents are read once. Workers know the test seeds by a filter of bounded size (``Filter``); only documents with a
    hit are written, with their words' hashes, and their hits meet the seeds by a join, then the items' words by another."""
    tests = tests.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).filter("text is not null")
    named = materialize(_items(tests))
    items = named.filter(F.size("words") >= min_words).dropDuplicates(["key"]).select("key", "words")
    sizes = [r["n"] for r in items.select(F.least(F.size("words"), F.lit(16)).alias("n")).distinct().collect()]  # 16 numbers at most
    seeds = materialize(_seeds(items, min_words))
    masks = sorted({m for n in sizes for m in seeds_for(n, min_words)})
    item_name = item_col if item_col.lower() != id_col.lower() else f"test_{item_col}"
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    if not masks:
        return rows.limit(0).select(F.col("doc").alias(id_col), F.lit(None).cast(named.schema["item"].dataType).alias(item_name), *(F.lit(0).cast("long").alias(c) for c in NAMES[2:5]), F.lit(0.0).alias("share"))
    known = _filter(seeds, masks)
    small = (lambda x: F.broadcast(x)) if seeds.count() <= SMALL else (lambda x: x)  # SMALL rows of some 30 bytes, items of no more words
    met = materialize(_hits(rows, docs.sparkSession.sparkContext.broadcast(known)).withColumn("row", F.monotonically_increasing_id()))
    hits = met.select("row", F.explode(F.arrays_zip("h", "at")).alias("x")).select("row", "x.h", F.col("x.at").alias("place"))
    starts = hits.join(small(seeds), "h").select("row", "key", (F.col("place") - F.col("at")).alias("start")).distinct()
    cells = starts.join(small(items.withColumnRenamed("words", "item")), "key")
    # A document with very many places is looked at in several rows.
    parts = cells.groupBy("row").agg(F.ceil(F.sum(F.size("item")) / CARRIED).alias("parts"))
    part = F.pmod(F.xxhash64("key", "start"), F.col("parts")).alias("part")
    grouped = cells.join(parts, "row").groupBy("row", part).agg(F.collect_list(F.struct("key", "start", "item")).alias("found"))
    found = _verified(met.select("row", "words").join(grouped, "row"), min_matches, min_share).dropDuplicates(["row", "key", "word_start"])
    placed = found.join(met.select("row", "doc"), "row").join(named.select("key", "item"), "key")
    return placed.select(F.col("doc").alias(id_col), F.col("item").alias(item_name), "word_start", "word_end", "n_matched", (F.col("n_matched") / F.col("n_item")).alias("share"))


def contaminated(docs: DataFrame, tests: DataFrame) -> DataFrame:
    """doc_id and item_id of every pair that overlaps, with its best place; one row a pair."""
    best = F.max(F.struct("n_matched", (-F.col("word_start")).alias("early"), "word_end", "share")).alias("b")
    return overlaps(docs, tests).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.n_matched", (-F.col("b.early")).alias("word_start"), "b.word_end", "b.share")


def clean(docs: DataFrame, tests: DataFrame) -> DataFrame:
    """The rows without any overlap, their columns as they were. Each row is judged by its own text: rows without an id
    like others, and rows of one id and different texts each for itself."""
    high, low = F.xxhash64("doc_id", "text"), F.xxhash64("text", "doc_id", F.lit(1))
    rows = docs.select(F.struct(high.alias("high"), low.alias("low")).alias("row"), "text")
    bad = overlaps(rows, tests, "row").select("row.*").distinct()
    return docs.join(bad, (high == bad["high"]) & (low == bad["low"]), "left_anti").select(*docs.columns)
