"""Phrase mining against counting in plain Python."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from featurekit.llm import phrases

COLUMNS = "doc_id bigint, text string, lang string"


def brute_force(rows, least, max_words, contained=100):
    """What mine_phrases gives, as lang, phrase: (a, l, r, n, score)."""
    counts, totals = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, max_words + 1):
                counts.update((lang, tuple(words[i : i + size])) for i in range(len(words) - size + 1))
    found = {}
    frequent = {k: f for k, f in counts.items() if f >= least and len(k[1]) > 1}
    inside = lambda a, b: any(b[i : i + len(a)] == a for i in range(len(b) - len(a) + 1))
    for (lang, p), a in frequent.items():
        if any(k == lang and len(q) > len(p) and inside(p, q) and 100 * f >= contained * a for (k, q), f in frequent.items()):
            continue
        cuts = [(counts[lang, p[:k]], counts[lang, p[k:]], k) for k in range(1, len(p))]
        score, _, left, right = min((1000 * a * totals[lang] // (x * y), k, x, y) for x, y, k in cuts)
        found[lang, " ".join(p)] = (a, left, right, totals[lang], score)
    return found


def mined(df, **options):
    return {(r["lang"], r["phrase"]): (r["a"], r["l"], r["r"], r["n"], r["score"]) for r in phrases.mine_phrases(df, **options).collect()}


def texts(seed, n):
    rng = random.Random(seed)
    words = ["a", "B", "the", "of", "é", "日本", "x\x00y", "x\x1cy", "a\xa0b", "It's", *(f"w{i}" for i in range(12))]
    weights = [1 / (i + 1) for i in range(len(words))]
    ends = [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "!?", ";", ":"]
    for i in range(n):
        body = "".join(w + rng.choice(ends) for w in rng.choices(words, weights, k=rng.randint(0, 60)))
        yield i, rng.choice([body, body, "of the a of the a of the", "A a a a a a a"]), rng.choice(["en", "de", None, "und"])


@pytest.mark.parametrize("seed,least,contained", [(1, 3, 100), (2, 8, 100), (3, 4, 60)])
def test_counts_and_scores_equal_brute_force(spark, monkeypatch, seed, least, contained):
    monkeypatch.setattr(phrases, "TOGETHER", 200)  # many stretches in a task
    rows = list(texts(seed, 250))
    df = spark.createDataFrame(rows, COLUMNS).repartition(5).withColumns({"piece": F.lit(1), "n": F.lit("x"), "a.b": F.lit(2)})
    want = brute_force(rows, least, 5, contained)
    assert mined(df, least=least, contained=contained) == want
    assert len(want) > 30 and {k for k, _ in want} == {"en", "de", "und"}


def test_odd_rows(spark):
    """Nulls, empty texts, repeated rows, a very long piece, no rows."""
    rows = [(1, None, "en"), (None, "", None), (2, " .,;\n", "en"), (2, "x y. X y", "en"), (2, "x y. X y", "en"), (None, "x y", None)]
    assert mined(spark.createDataFrame(rows, COLUMNS), least=2) == {("en", "x y"): (4, 4, 4, 8, 2000)}
    assert mined(spark.createDataFrame(rows, COLUMNS), least=1)["und", "x y"] == (1, 1, 1, 2, 2000)
    assert mined(spark.createDataFrame([], COLUMNS)) == {}
    assert mined(spark.createDataFrame(rows, COLUMNS), least=100) == {}
    long = [(1, "q r s " * 50_000, "en")]
    got = mined(spark.createDataFrame(long, COLUMNS), least=40_000)
    assert got["en", "q r s q r"] == (49_999, 50_000, 50_000, 150_000, 2999)
    assert mined(spark.createDataFrame(rows, COLUMNS).drop("lang"), lang_col=None, least=2)["und", "x y"][0] == 5


def test_ranks(spark):
    """Ties by occurrences, then by the phrase's bytes; as many as asked for of every language."""
    rows = [(0, "b c. " * 3 + "a d. " * 3 + "é z. " * 3 + "p q. " * 5, k) for k in ("en", "de")]
    got = phrases.top_phrases(spark.createDataFrame(rows, COLUMNS), top=3, least=3).orderBy("lang", "rank").collect()
    assert [(r["lang"], r["rank"], r["phrase"], r["score"]) for r in got] == [
        (k, i, p, s) for k in ("de", "en") for i, p, s in ((1, "a d", 9333), (2, "b c", 9333), (3, "é z", 9333))
    ]


def test_products_beyond_64_bits(spark):
    level = lambda rows: spark.createDataFrame(rows, "lang string, gram string, n bigint")
    a, left, right, n = 3 * 10**12, 10**13 + 7, 9 * 10**12 + 11, 10**16 + 3
    levels = [level([("en", "x", left), ("en", "y", right)]), level([("en", "x y", a)])]
    totals = spark.createDataFrame([("en", n)], "lang string, n bigint")
    assert phrases.score_phrases(levels, totals).first()["score"] == 1000 * a * n // (left * right)


def test_pieces_keep_their_multiplicity(spark):
    rows = [(i, "One two. one  two!\nTHREE", k) for i, k in itertools.product(range(3), ("en", None))]
    got = phrases.distinct_pieces(spark.createDataFrame(rows, COLUMNS)).collect()
    assert {(r["lang"], r["piece"]): r["n"] for r in got} == {(k, p): n for k in ("en", "und") for p, n in (("one two", 6), ("three", 3))}


def test_the_map_holds_every_frequent_gram(spark):
    grams = [("en", f"w{i} w{i + 1}", 5) for i in range(500)]
    known = phrases._map(spark.createDataFrame(grams, "lang string, gram string, n bigint"), 2)
    words = phrases._hashes(pa.array([f"w{i}" for i in range(501)]))
    words = phrases.mix64(words + phrases._hashes(pa.array(["en"] * 501)) * phrases._LANGUAGE)
    assert known[phrases._place(phrases.window_hashes(words, [0, 1]))].all()
    assert known.sum() <= 500 and phrases._map(spark.createDataFrame([], "lang string, gram string, n bigint"), 2) is None
    assert not known[phrases._place(np.array([12345], np.uint64))].any()
