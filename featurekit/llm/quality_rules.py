"""Quality rules (operator 12), with SQL functions only: a document's histograms of character classes and of common words
are compared with those of its language by the Jensen-Shannon distance, beside fixed rules on length and repetition.

References are statistics of the whole corpus: three passes over the texts, of which two shuffle only sums and word counts;
the last, which judges, shuffles nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featurekit.llm.common import discard, free_name, materialize, plainly_named

#: Blanks between words.
BLANK = r"\x20\x09-\x0D"
#: Character classes that are taken from a text one after another; of what remains, symbols below 128 (controls too),
#: letters and other characters beyond 127 follow.
CLASSES = {"lower": "a-z", "blank": BLANK, "upper": "A-Z", "digit": "0-9", "stop": r".,;:!?'\x22()\x2D"}
N_CLASSES = len(CLASSES) + 3
#: Rules: fewest words, and the largest share, in per cent, of words in repeated windows.
MIN_WORDS, MAX_REPEATED = 50, 50
#: Largest Jensen-Shannon distances (base 2, so at most 1) to the reference.
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.35, 0.35
#: Documents with fewer characters, or fewer words of letters, are not compared: so small histograms say little.
MIN_CHARS, MIN_LETTER_WORDS = 200, 100
#: A word is common if it makes up this share of its language's words; there are 1 / COMMON of these at most.
COMMON = 1 / 250
#: A language has a reference if it makes up this share of all characters, so there are 1 / SPOKEN of these at most.
SPOKEN = 1 / 1000

#: Bits of a window's place.
_PLACE = 22

#: Columns that judge() adds.
ADDED = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance",
    "word_distance", "kept",
]


def _with(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _without(text: Column, characters: str) -> Column:
    return F.regexp_replace(text, f"[{characters}]+", "")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{BLANK}]+"), "")


def letter_words(text: Column) -> Column:
    """Lower-cased runs of letters a to z and of characters beyond 127."""
    return F.array_remove(F.split(F.lower(text), r"[\x00-\x60\x7B-\x7F]+"), "")


def with_classes(df: DataFrame, text: str, out: str, symbols: str | None = None) -> DataFrame:
    """Column ``out``: how many characters of each class the text has; column ``symbols``: how many of ``#*$%&|<>``.

    Every class is taken out of what the one before left, so that all but the first work on short strings."""
    steps, last = [], text
    for k, characters in enumerate(CLASSES.values()):
        step = free_name(df, f"{out}_{k}")
        df = df.withColumn(step, _without(F.col(last), characters))
        steps, last = [*steps, (last, step)], step
    beyond = free_name(df, f"{out}_beyond")
    df = df.withColumn(beyond, _without(F.col(last), r"\x00-\x7F"))
    lengths = [F.length(a) - F.length(b) for a, b in [*steps, (last, beyond)]]
    others = F.length(_without(F.col(beyond), r"\p{L}\p{M}"))
    counts = F.array(*(x.cast("double") for x in [*lengths, F.length(beyond) - others, others]))
    df = df.withColumn(out, counts)
    if symbols:
        df = df.withColumn(symbols, F.length(F.regexp_replace(last, r"[^#*$%&|<>]+", "")).cast("bigint"))
    return df.drop(*(s for _, s in steps), beyond)


def repeated_words(words: Column) -> Column:
    """How many words lie in a window of three that occurs at least twice: n log n steps, whatever repeats.

    Hashes with the window's place in their low bits are sorted, so that equal ones are neighbours; the few windows that
    have such a neighbour are then compared as they are. Texts of over four million words compare all windows."""
    window = lambda w, i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    places = lambda w: F.sequence(F.lit(0), F.size(w) - 3)

    def alike(values: Column, key) -> Column:
        same = lambda x, k: F.coalesce(key(x) == key(F.get(values, k)), F.lit(False))
        return F.filter(values, lambda x, k: same(x, k - 1) | same(x, k + 1))

    def hashed(w: Column) -> Column:
        code = lambda i: F.shiftleft(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), _PLACE).bitwiseOR(i.cast("bigint"))
        found = _with(F.sort_array(F.transform(places(w), code)), lambda s: alike(s, lambda x: F.shiftright(x, _PLACE)))
        return F.transform(found, lambda x: x.bitwiseAND(2**_PLACE - 1).cast("int"))

    def again(w: Column, at: Column) -> Column:
        windows = F.sort_array(F.transform(at, lambda i: F.struct(window(w, i).alias("w"), i.alias("i"))))
        return F.sort_array(F.transform(_with(windows, lambda s: alike(s, lambda x: x["w"])), lambda x: x["i"]))

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - i, F.lit(3))))
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda total, gap: total + gap)

    def counted(w: Column) -> Column:
        at = F.when(F.size(w) < 2**_PLACE, hashed(w)).otherwise(places(w))
        return F.when(F.size(w) < 3, F.lit(0).cast("bigint")).otherwise(_with(again(w, at), covered))

    return _with(words, counted)


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier one."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{BLANK}]"))
    return _with(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint"))


def added_up(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def divergence(counts: Column, shares: Column) -> Column:
    """Jensen-Shannon distance of a histogram to shares that sum to one; null if the histogram is empty."""

    def term(x: Column, m: Column) -> Column:
        return F.when(x > 0, 0.5 * x * F.log2(x / m)).otherwise(0.0)

    def both(c: Column, q: Column, total: Column) -> Column:
        return _with(c / total, lambda p: _with((p + q) / 2, lambda m: term(p, m) + term(q, m)))

    def of(c: Column, total: Column) -> Column:
        parts = F.zip_with(c, shares, lambda x, q: both(x, q, total))
        return F.when(total > 0, F.sqrt(F.greatest(added_up(parts), F.lit(0.0))))

    return _with(counts, lambda c: _with(added_up(c), lambda total: of(c, total)))


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row for each language that makes up a share of ``SPOKEN`` of all characters: language, shares of the character
    classes, common words by frequency, and their shares with that of all other words at the end.

    Every document counts by its length; null languages are one language, ``und``. Small: at most 1 / SPOKEN rows of at
    most 1 / COMMON words. It is written to the shared folder, so that judging does not compute it again."""
    texts = docs.select(
        F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    sums = [F.sum(F.col("classes")[k]).alias(f"c{k}") for k in range(N_CLASSES)]
    written = materialize(with_classes(texts, "text", "classes").groupBy("lang").agg(*sums))
    classes = written.select("lang", F.array(*(f"c{k}" for k in range(N_CLASSES))).alias("classes"))
    classes = classes.withColumn("chars", added_up(F.col("classes")))
    total = classes.agg(F.sum("chars")).first()[0] or 0.0
    spoken = classes.filter((F.col("chars") > 0) & (F.col("chars") >= SPOKEN * total))
    names = [r["lang"] for r in spoken.select("lang").collect()]  # at most 1 / SPOKEN
    counts = texts.filter(F.col("lang").isin(names)).select("lang", F.explode(letter_words(F.col("text"))).alias("word"))
    counts = materialize(counts.groupBy("lang", "word").count())
    sizes = F.broadcast(counts.groupBy("lang").agg(F.sum("count").alias("words")))  # a row for each language
    common = counts.join(sizes, "lang").filter(F.col("count") >= F.lit(COMMON) * F.col("words"))
    entry = F.struct((-F.col("count")).alias("minus"), "word", (F.col("count") / F.col("words")).alias("share"))
    common = common.groupBy("lang").agg(F.sort_array(F.collect_list(entry)).alias("common"))
    shares = F.transform("common", lambda x: x["share"])
    found = spoken.join(common, "lang", "left").select(
        F.col("lang").alias("ref_lang"),
        F.transform("classes", lambda c: c / F.col("chars")).alias("ref_classes"),
        F.transform("common", lambda x: x["word"]).alias("ref_words"),
        F.concat(shares, F.array(F.greatest(1 - added_up(shares), F.lit(0.0)))).alias("ref_shares"),
    )
    out = materialize(found)
    discard(written, counts)
    return out


def judge(
    docs: DataFrame,
    refs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    *,
    max_class_distance: float = MAX_CLASS_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
) -> DataFrame:
    """The rows with the columns of ``ADDED``; those that the rows have are replaced, all others stay.

    ``base_failed``: fewer than 50 words, or more than half of the words in repeated windows of three. ``kept``: not
    failed, and both distances within their limits. A distance is null, and fails nothing, where the text is shorter than
    the guard asks or its language has no reference. Null texts count as empty, null languages as ``und``; every row is
    judged by itself, whatever its id, and an empty table stays empty."""
    plain = plainly_named(docs)
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    kept = [c for c in docs.columns if c.lower() not in ADDED]
    df = plain.select(
        *(at[c] for c in kept),
        F.coalesce(F.col(at[text_col]), F.lit("")).alias("_text"),
        F.coalesce(F.col(at[lang_col]), F.lit("und")).alias("_lang"),
    )
    df = with_classes(df, "_text", "_classes", "n_symbols").withColumn("_words", words_of(F.col("_text")))
    df = df.join(F.broadcast(refs), F.col("_lang") == F.col("ref_lang"), "left")  # its size is bounded, see references
    letters = letter_words(F.col("_text"))

    def histogram(w: Column) -> Column:
        known = F.transform("ref_words", lambda r: (F.size(w) - F.size(F.array_remove(w, r))).cast("double"))
        return _with(known, lambda k: F.concat(k, F.array(F.size(w) - added_up(k))))

    judged = lambda w: (F.size(w) >= MIN_LETTER_WORDS) & (F.size("ref_words") > 0)
    word_distance = _with(letters, lambda w: F.when(judged(w), divergence(histogram(w), F.col("ref_shares"))))
    long_enough = (F.length("_text") >= MIN_CHARS) & F.col("ref_classes").isNotNull()
    df = df.withColumns({
        "n_words": F.size("_words").cast("bigint"),
        "word_chars": (F.length("_text") - F.col("_classes")[list(CLASSES).index("blank")]).cast("bigint"),
        "n_dup_lines": repeated_lines(F.col("_text")),
        "n_repeat_words": repeated_words(F.col("_words")),
        "class_distance": F.when(long_enough, F.round(divergence(F.col("_classes"), F.col("ref_classes")), 6)),
        "word_distance": F.round(word_distance, 6),
    })
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    near = (F.coalesce(F.col("class_distance"), F.lit(0.0)) <= max_class_distance) & (
        F.coalesce(F.col("word_distance"), F.lit(0.0)) <= max_word_distance
    )
    df = df.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & near)
    return df.select(*(at[c] for c in kept), *ADDED).toDF(*kept, *ADDED)


def document_rules(docs: DataFrame) -> DataFrame:
    """Measures and verdict of every document."""
    docs = docs.select("doc_id", "text", "lang")
    return judge(docs, references(docs)).select("doc_id", *ADDED)


def _sql_distance(counts: str, shares: str) -> str:
    """DuckDB's Jensen-Shannon distance of two lists."""
    p, q = f"z[1] / list_sum({counts})", "z[2]"
    m = f"(({p} + {q}) / 2)"
    term = lambda x: f"CASE WHEN {x} > 0 THEN 0.5 * {x} * log2({x} / {m}) ELSE 0 END"
    return f"round(sqrt(greatest(list_sum([{term(p)} + {term(q)} for z in list_zip({counts}, {shares})]), 0)), 6)"


def _sql() -> str:
    steps, last = [], "x"
    for k, characters in enumerate(CLASSES.values()):
        steps.append(f"r{k} AS (SELECT *, regexp_replace({last}, '[{characters.replace(chr(39), chr(39) * 2)}]+', '', 'g') AS x{k} FROM {f'r{k - 1}' if k else 't'})")
        last = f"x{k}"
    names = ["x", *(f"x{k}" for k in range(len(CLASSES))), "b"]
    counts = [f"length({a}) - length({b})" for a, b in zip(names, names[1:], strict=False)]
    others = r"length(regexp_replace(b, '[\p{L}\p{M}]+', '', 'g'))"
    counts += [f"length(b) - {others}", others]
    return rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, 'und') AS lang, coalesce(text, '') AS x FROM documents),
{", ".join(steps)},
beyond AS (SELECT *, regexp_replace({last}, '[\x00-\x7F]+', '', 'g') AS b FROM r{len(CLASSES) - 1}),
c AS (SELECT r, doc_id, lang, x, [{", ".join(f"CAST({n} AS DOUBLE)" for n in counts)}] AS cc,
  length(regexp_replace({last}, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
  list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws,
  list_filter(regexp_split_to_array(lower(x), '[\x00-\x60\x7B-\x7F]+'), lambda w: w <> '') AS lw,
  list_filter(string_split(x, chr(10)), lambda w: regexp_matches(w, '[^\x20\x09-\x0D]')) AS ls FROM beyond),
k AS (SELECT lang, {", ".join(f"sum(cc[{i + 1}]) AS s{i}" for i in range(N_CLASSES))}, sum(length(x)) AS chars FROM c GROUP BY lang),
spoken AS (SELECT lang, [{", ".join(f"s{i} / chars" for i in range(N_CLASSES))}] AS cq FROM k
  WHERE chars > 0 AND chars >= {SPOKEN} * (SELECT sum(chars) FROM k)),
wc AS (SELECT lang, w, count(*) AS n FROM (SELECT lang, unnest(lw) AS w FROM c WHERE lang IN (SELECT lang FROM spoken)) GROUP BY ALL),
cw AS (SELECT lang, w, n / t.words AS share, n FROM wc JOIN (SELECT lang, sum(n) AS words FROM wc GROUP BY lang) t USING (lang) WHERE n >= {COMMON} * t.words),
cl AS (SELECT lang, list(w ORDER BY n DESC, w) AS rw, list(share ORDER BY n DESC, w) AS rs FROM cw GROUP BY lang),
refs AS (SELECT spoken.lang, cq, rw, list_append(rs, greatest(1 - list_sum(rs), 0)) AS wq FROM spoken LEFT JOIN cl USING (lang)),
g AS (SELECT r, i, x FROM (SELECT r, unnest([{{'i': i, 'x': array_to_string(ws[i:i + 2], ' ')}} for i in range(1, len(ws) - 1)], recursive := true) FROM c WHERE len(ws) >= 3)),
again AS (SELECT r, i FROM g SEMI JOIN (SELECT r, x FROM g GROUP BY r, x HAVING count(*) > 1) USING (r, x)),
rep AS (SELECT r, count(DISTINCT i) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS i FROM again) GROUP BY r),
own AS (SELECT r, lang, count(*) AS m, w FROM (SELECT r, lang, unnest(lw) AS w FROM c) GROUP BY r, lang, w),
hits AS (SELECT r, map_from_entries(list((w, m))) AS mm FROM own SEMI JOIN cw USING (lang, w) GROUP BY r),
h AS (SELECT c.*, cq, wq, rw, [CAST(coalesce(mm[w], 0) AS DOUBLE) for w in rw] AS known FROM c LEFT JOIN refs USING (lang) LEFT JOIN hits USING (r)),
f AS (SELECT *, list_append(known, len(lw) - list_sum(known)) AS wh FROM h),
d AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(x) - cc[2] AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
  CASE WHEN length(x) >= {MIN_CHARS} AND cq IS NOT NULL THEN {_sql_distance("cc", "cq")} END AS class_distance,
  CASE WHEN len(lw) >= {MIN_LETTER_WORDS} AND len(rw) > 0 THEN {_sql_distance("wh", "wq")} END AS word_distance FROM f LEFT JOIN rep USING (r)),
v AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM d)
SELECT *, NOT base_failed AND coalesce(class_distance, 0) <= {MAX_CLASS_DISTANCE} AND coalesce(word_distance, 0) <= {MAX_WORD_DISTANCE} AS kept FROM v
"""


#: The same rows.
SQL = _sql()
