"""Quality rules against plain Python."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from featurekit.llm import quality_rules

COLUMNS = "doc_id bigint, text string, lang string"
BLANK = "\x20\x09-\x0d"


def base(text):
    text = text or ""
    words = re.findall(rf"[^{BLANK}]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + d for i, w in enumerate(windows) if often[w] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if re.search(rf"[^{BLANK}]", x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "base_failed": failed,
    }


def classes(text):
    import unicodedata

    out = [0] * 8
    for c in text:
        if "a" <= c <= "z":
            out[0] += 1
        elif re.match(rf"[{BLANK}]", c):
            out[1] += 1
        elif "A" <= c <= "Z":
            out[2] += 1
        elif "0" <= c <= "9":
            out[3] += 1
        elif c in ".,;:!?'\"()-":
            out[4] += 1
        elif c < "\x80":
            out[5] += 1
        else:
            out[6 if unicodedata.category(c)[0] in "LM" else 7] += 1
    return out


def letters(text):
    return [w for w in re.split(r"[\x00-\x60\x7B-\x7F]+", text.lower()) if w]


def distance(p, q):
    total = sum(p)
    if not total:
        return None
    out = 0.0
    for x, y in zip((c / total for c in p), q, strict=True):
        m = (x + y) / 2
        out += sum(0.5 * v * math.log2(v / m) for v in (x, y) if v > 0)
    return math.sqrt(max(out, 0.0))


def distances(rows):
    """Class and word distance of every row, to references over all rows."""
    rows = [("und" if k is None else k, t or "") for _, t, k in rows]
    out, total = [], sum(len(t) for _, t in rows)
    refs = {}
    for lang in {k for k, _ in rows}:
        own = [t for k, t in rows if k == lang]
        sums = [sum(c) for c in zip(*map(classes, own), strict=True)]
        if sum(sums) and sum(sums) >= quality_rules.SPOKEN * total:
            counts = Counter(w for t in own for w in letters(t))
            n = sum(counts.values())
            common = {w: c / n for w, c in counts.items() if c >= quality_rules.COMMON * n}
            refs[lang] = [c / sum(sums) for c in sums], common
    for lang, text in rows:
        shares, common = refs.get(lang, (None, {}))
        found = letters(text)
        hits = Counter(w for w in found if w in common)
        words = [hits[w] for w in common] + [len(found) - sum(hits.values())]
        out.append((
            distance(classes(text), shares) if shares and len(text) >= 200 else None,
            distance(words, [*common.values(), max(1 - sum(common.values()), 0)]) if len(found) >= 100 and common else None,
        ))
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    stock = {k: [f"{k}{''.join(rng.choices('aeinrst', k=rng.randint(1, 5)))}" for _ in range(60)] for k in ("en", "de", None, "rare")}
    for i in range(n):
        lang = rng.choices(["en", "de", None, "rare"], [9, 9, 9, 0.05])[0]
        words = rng.choices(stock[lang], [1 / (k + 1) for k in range(60)], k=rng.randint(0, 260))
        text = "".join(w + rng.choice([" ", " ", "  ", ". ", "\n", "\t", " é日 ", " “x” ", "#|1 "]) for w in words)
        yield i, rng.choice([text, text, text.upper(), " | ".join(words), "again and again " * 40, text + "\n" + text]), lang


@pytest.mark.parametrize("seed", [1, 2])
def test_measures_and_distances_equal_brute_force(spark, seed):
    rows = list(corpus(seed, 150))
    got = {r["doc_id"]: r for r in quality_rules.document_rules(spark.createDataFrame(rows, COLUMNS).repartition(3)).collect()}
    near = lambda d, most: d is None or d <= most
    for (i, text, _), (by_class, by_word) in zip(rows, distances(rows), strict=True):
        row, want = got[i], base(text)
        assert {k: row[k] for k in want} == want
        assert row["class_distance"] == pytest.approx(by_class, abs=2e-6) and row["word_distance"] == pytest.approx(by_word, abs=2e-6)
        both = near(row["class_distance"], quality_rules.MAX_CLASS_DISTANCE) and near(row["word_distance"], quality_rules.MAX_WORD_DISTANCE)
        assert row["kept"] == (not want["base_failed"] and both)
    assert {r["kept"] for r in got.values() if not r["base_failed"]} == {True, False}


def test_repeated_windows(spark, monkeypatch):
    """Overlaps, ties, and the way for texts with too many words for the places' bits."""
    cases = ["a b c a b c", "a a a a", "a a a", "a b", "", None, "x a b c y a b c z", "a b c d a b x b c d", "a  b\tc a b\nc " * 30, "é ü ß é ü ß é", "A b c a b c"]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, text string")
    counted = lambda: [r[0] for r in df.orderBy("i").select(quality_rules.repeated_words(quality_rules.words_of(F.coalesce("text", F.lit(""))))).collect()]
    want = [base(t)["n_repeat_words"] for t in cases]
    assert counted() == want and sum(want) > 0
    monkeypatch.setattr(quality_rules, "_PLACE", 3)
    assert counted() == want


def test_odd_rows(spark):
    """Nulls, empty and very long texts, repeated rows, no rows, clashing and odd column names."""
    prose = " ".join(f"word{i}" for i in range(200))
    rows = [(None, None, None), (None, "", "en"), (1, prose, "en"), (1, prose, "en"), (2, "q w e " * 60_000, "en"), (3, prose, None)]
    df = spark.createDataFrame(rows, COLUMNS).withColumns({"kept": F.lit("x"), "N_words": F.lit(0), "a.b": F.lit(4), "_text": F.lit(5)})
    got = quality_rules.judge(df, quality_rules.references(df))
    assert got.columns == ["doc_id", "text", "lang", "a.b", "_text", *quality_rules.ADDED]
    by = {}
    for r in got.collect():
        by.setdefault(r["doc_id"], []).append(r)
    assert [r["n_words"] for r in by[None]] == [0, 0] and not any(r["kept"] for r in by[None])
    assert len(by[1]) == 2 and by[1][0] == by[1][1] and by[3][0]["kept"]
    assert by[2][0]["n_repeat_words"] == by[2][0]["n_words"] == 180_000 and not by[2][0]["kept"]
    empty = spark.createDataFrame([], COLUMNS)
    assert quality_rules.document_rules(empty).count() == 0
    assert quality_rules.judge(df, quality_rules.references(empty)).filter("kept").count() == 3


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a b c", "en")], COLUMNS)
    df.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/rules")
    plan = quality_rules.document_rules(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan)
