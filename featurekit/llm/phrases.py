"""Phrase collocation mining (operator 11): phrases of two to five words that stand together more often than their parts
would by chance, for each language.

Identical pieces (stretches without punctuation) are kept once, with their multiplicity. Words, pairs and longer n-grams
are then counted one after another: a task adds up weights of equal n-grams among the pieces it reads, a shuffle deals them
out by their hash, and each hash bucket is counted by duckdb out of core, so that a bucket may exceed memory. An n-gram can
be frequent only if all n-grams within it are; a bitmap of fixed size lets most others go before the shuffle. Since
equal n-grams travel as one row for each stretch of input, no n-gram is a hot key. Scores ask for the counts of a phrase's
parts by shuffled requests, each meeting the part's count by a join."""

from __future__ import annotations

import shutil
import tempfile
from collections import Counter
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from featurekit.llm.common import discard, materialize, mix64, plainly_named, slices, window_hashes, word_hashes

#: Longest phrase, fewest occurrences, and how many phrases of a language are reported.
MAX_WORDS, MIN_COUNT, TOP = 5, 100, 2000
#: A phrase goes if a longer one that holds it has this share, in per cent, of its occurrences.
CONTAINED = 100
#: Bits of the map of frequent n-grams (2 MB), whatever their number: it decides what is shuffled, never what counts.
MAP_BITS = 24
#: Words that a task adds up at once, and duckdb's memory for a bucket; beyond it, it writes to the task's own folder.
TOGETHER, BUCKET_MEMORY = 1 << 20, "256MB"

_LANGUAGE = np.uint64(0x9E3779B97F4A7C15)
_PIECES = "lang string, piece string, n bigint"
_COUNTS = "lang string, gram string, n bigint"
_ARROW = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("following", pa.int32()), ("n", pa.int64())])
_ARROW = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])
#: A-Z to a-z, what ends a piece to a line feed, a tab to a space.
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\x0d\x09", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")


def split_pieces(text: str) -> Iterator[str]:
    """Pieces that have a word, their words joined by one space each."""
    for raw in text.encode().translate(_FOLD).split(b"\n"):
        if piece := b" ".join(raw.split()):
            yield piece.decode()


def distinct_pieces(docs: DataFrame, text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """Every distinct piece of a language, with how often it stands in the texts."""
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und")) if lang_col else F.lit("und")
    rows = docs.select(lang.alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2000):
            found: Counter[tuple[str, str]] = Counter()
            for one, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found.update((one, p) for p in split_pieces(text))
            cells = [[k for k, _ in found], [p for _, p in found], list(found.values())]
            types = [pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, cells, types)), ["lang", "piece", "n"])

    return rows.mapInArrow(run, _PIECES).groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def words_in(column: str) -> Column:
    return F.length(column) - F.length(F.replace(column, F.lit(" "))) + 1


def _place(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - MAP_BITS)).astype(np.int64)


def _hashes(texts: pa.Array) -> np.ndarray:
    return word_hashes(texts.cast(pa.binary()).to_pylist())


class _Stretch:
    """Some pieces as numbers, one for each word of a language, in the order in which they stand."""

    def __init__(self, t: pa.Table):
        parts = pc.split_pattern(t["piece"].combine_chunks(), " ")
        self.piece = np.repeat(np.arange(len(t)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
        words, langs = pc.list_flatten(parts).dictionary_encode(), t["lang"].combine_chunks().dictionary_encode()
        self.words, self.langs, self.weights = words.dictionary, langs.dictionary, t["n"].to_numpy()
        self.code = langs.indices.to_numpy().astype(np.int64)[self.piece] * len(self.words) + words.indices.to_numpy()

    def hashes(self) -> np.ndarray:
        """Of the word, with its language, at every place."""
        word, lang = _hashes(self.words)[self.code % len(self.words)], _hashes(self.langs)[self.code // len(self.words)]
        return mix64(word + lang * _LANGUAGE)

    def grams(self, sizes: list[int], known: np.ndarray | None, gate: int) -> Iterator[pa.Table]:
        """The n-grams of some sizes with their added weights, without those that hold an n-gram of ``gate`` words that the
        map rules out."""
        if len(self.code) < sizes[0]:
            return
        if known is not None:
            frequent = known[_place(window_hashes(self.hashes(), list(range(gate))))]
        starts, number, size = np.arange(len(self.code)), self.code, 1
        for wanted in sizes:
            while size < wanted:
                # Equal n-grams by numbers, word after word, so that equality is exact.
                size += 1
                fits = np.flatnonzero(starts < len(self.piece) - size + 1)
                fits = fits[self.piece[starts[fits]] == self.piece[starts[fits] + size - 1]]
                if known is not None and size >= gate:
                    for k in range(size - gate + 1) if size == max(gate, 2) else [size - gate]:
                        fits = fits[frequent[starts[fits] + k]]
                starts, number = starts[fits], number[fits]
                key = number * (len(self.words) * len(self.langs)) + self.code[starts + size - 1]
                order, first = _runs(key)
                number = np.empty(len(key), np.int64)
                number[order] = np.cumsum(first) - 1
            if not len(starts):
                return
            order, first = _runs(number)
            at = starts[order[first]]
            gram = [self.words.take(pa.array(self.code[at + k] % len(self.words))) for k in range(size)]
            text = pc.binary_join_element_wise(*gram, pa.scalar(" ")) if size > 1 else gram[0]
            sums = np.add.reduceat(self.weights[self.piece[starts]][order], np.flatnonzero(first))
            yield pa.table([self.langs.take(pa.array(self.code[at] // len(self.words))), text, pa.array(sums)], schema=_ARROW)


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal keys together, and where in it each begins."""
    order = np.argsort(key, kind="stable")
    first = np.ones(len(key), bool)
    first[1:] = key[order][1:] != key[order][:-1]
    return order, first


def _added(sizes: list[int], known: np.ndarray | None, gate: int):
    """What a task makes of its pieces: their n-grams, equal ones as one row for each ``TOGETHER`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            for found in _Stretch(pa.Table.from_batches(waiting)).grams(sizes, known, gate):
                yield from found.to_batches(max_chunksize=50_000)

        for b in batches:
            waiting.append(b)
            held += pc.sum(pc.add(pc.count_substring(b.column(1), " "), 1)).as_py() or 0
            if held >= TOGETHER:
                yield from out()
                waiting, held = [], 0
        if held:
            yield from out()

    return run


def _counted(least: int):
    """Counts of a hash bucket by duckdb, in a folder of the task's own that goes with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = tempfile.mkdtemp()
        db = duckdb.connect(f"{folder}/bucket", config={"memory_limit": BUCKET_MEMORY, "threads": 1, "temp_directory": folder})
        try:
            db.execute("SET preserve_insertion_order = false")
            db.execute("CREATE TABLE part (lang VARCHAR, gram VARCHAR, n BIGINT)")
            for b in batches:
                db.register("batch", pa.Table.from_batches([b]))
                db.execute("INSERT INTO part SELECT * FROM batch")
                db.unregister("batch")
            sums = "SELECT lang, gram, CAST(sum(n) AS BIGINT) AS n FROM part GROUP BY lang, gram"
            for b in db.sql(f"{sums} HAVING sum(n) >= {int(least)}").to_arrow_reader(50_000):
                yield b.cast(_ARROW)
        finally:
            db.close()
            shutil.rmtree(folder, ignore_errors=True)

    return run


def _map(counts: DataFrame, size: int) -> np.ndarray | None:
    """A bit for the hash of every frequent n-gram; None if there is none. What comes to the driver is the map itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << MAP_BITS, bool)
        for b in batches:
            if b.num_rows:
                words = _hashes(pc.list_flatten(pc.split_pattern(b.column(1), " ")))
                found = window_hashes(mix64(words + np.repeat(_hashes(b.column(0)), size) * _LANGUAGE), list(range(size)))
                bits[_place(found[::size])] = True
        rows = np.packbits(bits).view(">i8")
        at = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(rows[at].astype(np.int64))], ["at", "bits"])

    words = counts.mapInArrow(run, "at bigint, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
    if not len(words):
        return None
    rows = np.zeros((1 << MAP_BITS) // 64, ">i8")
    rows[words["at"].to_numpy()] = words["bits"].to_numpy()
    return np.unpackbits(rows.view(np.uint8)).astype(bool)


def frequent_grams(pieces: DataFrame, max_words: int = MAX_WORDS, least: int = MIN_COUNT) -> list[DataFrame]:
    """Frequent n-grams (lang, gram, n): words, then pairs of frequent words, then what holds frequent pairs only, then all
    longer ones that hold frequent n-grams of three words only; fewer if none of a size are frequent."""
    levels: list[DataFrame] = []
    known = None
    for gate, sizes in enumerate([[1], [2], [3], list(range(4, max_words + 1))]):
        wanted = [k for k in sizes if k <= max_words]
        if gate and (not wanted or (known := _map(levels[-1], gate)) is None):
            break
        rows = pieces.mapInArrow(_added(wanted, known, gate), _COUNTS).repartition("lang", "gram")
        levels.append(materialize(rows.mapInArrow(_counted(least), _COUNTS)))
    return levels


def score_phrases(levels: list[DataFrame], totals: DataFrame, contained: int = CONTAINED) -> DataFrame:
    """Every phrase that no longer one holds as often, with the counts of its parts at the cut that scores least.

    Sums and products are decimals of 38 digits, so exact for corpora of up to 10^17 words."""
    counts = levels[0]
    for df in levels[1:]:
        counts = counts.unionByName(df)
    counts = counts.select("lang", "gram", F.col("n").alias("f"), words_in("gram").alias("size"))
    # A phrase within a longer one is within one of a word more that is no rarer.
    within = F.array(F.expr("substring_index(gram, ' ', size - 1)"), F.expr("substring_index(gram, ' ', 1 - size)"))
    longer = counts.filter(F.col("size") > 2).select("lang", F.explode(within).alias("gram"), "f")
    longer = longer.groupBy("lang", "gram").agg(F.max("f").alias("longest"))
    phrases = counts.filter(F.col("size") > 1).join(longer, ["lang", "gram"], "left")
    phrases = phrases.filter(F.coalesce(100 * F.col("longest") < contained * F.col("f"), F.lit(True)))
    cuts = phrases.select("lang", F.col("gram").alias("phrase"), F.col("f").alias("a"), "size", F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    requests = cuts.withColumns({"left": F.expr("substring_index(phrase, ' ', k)"), "right": F.expr("substring_index(phrase, ' ', k - size)")})
    answers = counts.select("lang", F.col("gram").alias("left"), F.col("f").alias("l"))
    requests = requests.join(answers, ["lang", "left"])
    requests = requests.join(answers.toDF("lang", "right", "r"), ["lang", "right"]).join(totals.withColumnRenamed("n", "total"), "lang")
    score = "CAST(1000 AS DECIMAL(4, 0)) * CAST(a AS DECIMAL(17, 0)) * CAST(total AS DECIMAL(17, 0)) DIV (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))"
    cut = F.min(F.struct(F.expr(score).cast("bigint").alias("score"), "k", "l", "r")).alias("cut")
    best = requests.groupBy("lang", "phrase", "a", "total").agg(cut)
    return best.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("total").alias("n"), F.col("cut.score").alias("score"))


def mine_phrases(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str | None = "lang",
    *,
    max_words: int = MAX_WORDS,
    least: int = MIN_COUNT,
    contained: int = CONTAINED,
) -> DataFrame:
    """All phrases of two words to ``max_words`` with ``least`` occurrences: lang, phrase, a (its occurrences), l and r
    (those of its parts), n (words of the language) and score, floor(1000 * a * n / (l * r)).

    Null texts count as empty, null languages as ``und``; without a language column all texts are one language. Rows are
    counted as often as they stand in the table, whatever their ids; other columns play no part. An empty table, or one
    without frequent phrases, gives no rows."""
    plain = plainly_named(docs)
    name = lambda c: f"c{docs.columns.index(c)}"
    pieces = materialize(distinct_pieces(plain, name(text_col), name(lang_col) if lang_col else None))
    totals = materialize(pieces.groupBy("lang").agg(F.sum(F.col("n") * words_in("piece")).alias("n")))
    levels = frequent_grams(pieces, max_words, least)
    discard(pieces)
    return score_phrases(levels, totals, contained)


def top_phrases(docs: DataFrame, top: int = TOP, **options) -> DataFrame:
    """The best phrases of every language, ranked by score, occurrences and the phrase's bytes."""
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = mine_phrases(docs, **options).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: The same rows.
SQL = rf"""
WITH p AS (SELECT row_number() OVER () AS id, lang, regexp_extract_all(x, '[^\x20\x09]+') AS ws FROM (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS x FROM documents)),
t AS (SELECT lang, sum(len(ws)) AS n FROM p GROUP BY lang),
i AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM p),
g AS (SELECT lang, ws[i:i + k - 1] AS ws, k FROM i, range(1, {MAX_WORDS + 1}) r(k) WHERE i + k - 1 <= len(ws)),
f AS (SELECT lang, ws, k AS size, array_to_string(ws, ' ') AS phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= {MIN_COUNT}),
longer AS (SELECT DISTINCT b.lang, b.phrase FROM f a JOIN f b ON a.lang = b.lang AND a.size > b.size AND contains(' ' || a.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * a.f >= {CONTAINED} * b.f WHERE b.size > 1),
c AS (SELECT f.*, unnest(range(1, size)) AS k FROM f ANTI JOIN longer USING (lang, phrase) WHERE size > 1),
s AS (SELECT c.lang, c.phrase, c.f AS a, l.f AS l, r.f AS r, t.n, c.k, CAST(1000 * CAST(c.f AS HUGEINT) * t.n // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM c JOIN f l ON l.lang = c.lang AND l.ws = c.ws[1:c.k] JOIN f r ON r.lang = c.lang AND r.ws = c.ws[c.k + 1:c.size] JOIN t ON t.lang = c.lang),
o AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM q WHERE rank <= {TOP}
"""
