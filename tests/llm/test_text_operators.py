import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from featurekit.llm import decontaminate, license_scan, near_dedup, packing, token_counts

PIECES, WORDS = str(public_tokenizers.path("piece_bpe_32k.model")), str(public_tokenizers.path("word_bpe_49k.json"))
ODD = ["", " ", "  a  b ", "a\n\nb \n c", "\n", "<s> x</s> <unk>", "▁a ▁ b▁", "日本語 テスト\tx", "é Σας ΑΣ İi ſ ª²½ x\x1cy\xa0z\x85 <|endoftext|>a <|startoftext|>b", "it's I'LL we've 'd'D o'RE rock'n'roll", "a­y​", "x\x00y", "a" * 5000, "\r\n \r\n", " \n \n  x", "ŉ ǆ ß ẞ ﬁ", "word " * 3000, None]


def documents(spark, texts, **extra):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    for name, value in extra.items():
        df = df.withColumn(name, F.lit(value))
    return df


@pytest.mark.parametrize("frequent", [500_000, 7, 1])
def test_token_counts(spark, monkeypatch, frequent):
    """The last two leave nearly all pre-tokens to the join."""
    monkeypatch.setattr(token_counts, "FREQUENT", frequent)
    monkeypatch.setattr(token_counts, "GATHERED", max(frequent, 2))
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r["doc_id"]: r for r in token_counts.document_tokens(documents(spark, ODD, n_tokens=1, n_bytes="x"), PIECES).collect()}
    for i, t in enumerate(ODD):
        assert got[i]["n_tokens"] == len(sp.encode(t or ""))
        assert got[i]["n_bytes"] == len((t or "").encode())
    assert token_counts.count_tokens(documents(spark, ODD, n_tokens=1).withColumnRenamed("doc_id", "id"), PIECES).count() == len(ODD)
    assert token_counts.document_tokens(documents(spark, []), PIECES).count() == 0
    twice = documents(spark, ["one two", "one two"]).withColumns({"doc_id": F.lit(None).cast("bigint"), "a.b": F.lit(3)})
    assert [(r["doc_id"], r["a.b"], r["n_tokens"]) for r in token_counts.count_tokens(twice, PIECES).collect()] == [(None, 3, len(sp.encode("one two")))] * 2


def test_each_pre_token_is_counted_once(spark):
    units = token_counts._gathered(documents(spark, ["a b a", "b  c\n", None, "a"]).select("text"))
    assert {r["unit"]: r["n"] for r in units.collect()} == {" a": 3, " b": 2, "  c": 1, "\n": 1}


def test_packing_is_a_round_trip(spark):
    tok = Tokenizer.from_file(WORDS)
    docs = documents(spark, [*ODD, "x", "x"], length=1, offset=2, ids="clash")
    rows = packing.pack(docs, WORDS).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    for i, t in enumerate([*ODD, "x", "x"]):
        want = tok.encode(t or "", add_special_tokens=False).ids + [1]
        pieces = sorted(by[i], key=lambda r: r["start"])
        assert np.concatenate([np.frombuffer(p["ids"], "<u4") for p in pieces]).tolist() == want
        assert [p["start"] for p in pieces] == np.cumsum([0, *(p["length"] for p in pieces)])[:-1].tolist()
        assert all(p["length"] <= 2048 and not p["length"] & (p["length"] - 1) and p["offset"] == 0 and p["doc_tokens"] == len(want) for p in pieces)
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    digest = packing.packed_digest(packing.pack(docs, WORDS)).collect()
    assert sorted(r["ids_crc32"] for r in digest) == sorted(zlib.crc32(r["ids"]) for r in rows)
    assert packing.pack(documents(spark, []), WORDS).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, WORDS, limit=1000)


def test_lengths():
    assert packing.lengths(2048 * 2 + 5, 2048) == [2048, 2048, 4, 1] and packing.lengths(1, 2048) == [1]


def brute_components(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            k = len(a & sets[j])
            if a and sets[j] and 100 * k >= 75 * (len(a) + len(sets[j]) - k):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def corpus(seed=1):
    """Groups of copies, chains of edits, a passage that many share, short and empty texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    text = lambda n: [word() for _ in range(n)]
    edit = lambda w, n: [word() if k in set(rng.sample(range(len(w)), n)) else x for k, x in enumerate(w)]
    passage, out = text(40), [None, "", " \n", "one two", "One TWO", "one two three", "a b c d e", "a b c d E"]
    base = text(120)
    out += [" ".join(base)] * 15 + [" ".join(edit(base, rng.randint(1, 6))) for _ in range(60)]
    chain = text(90)
    for _ in range(25):
        chain = edit(chain, 1) if rng.random() < 0.6 else [*chain[1:], word()]
        out.append(" ".join(chain))
    out += [" ".join([*passage, *text(rng.randint(3, 60))]) for _ in range(60)]
    out += [" ".join(text(rng.randint(5, 40))) for _ in range(40)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_equal_brute_force(spark, seed):
    texts = corpus(seed)
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(documents(spark, texts, key="k", n=1, values="v", kept="x")).collect()}
    sizes, roots = brute_components(texts)
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert [got[i]["component_id"] for i in range(len(texts))] == roots
    assert all(got[i]["kept"] == (roots[i] == i) for i in range(len(texts)))


def test_near_duplicates_of_odd_rows(spark):
    assert near_dedup.near_duplicates(documents(spark, [])).count() == 0
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, ""), (2, None), (3, "A b c d e f")], "doc_id bigint, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df).collect() if r["component_id"] is not None)
    assert got == [(-1, 1, False), (1, 1, True), (1, 1, True), (2, 2, True), (3, 1, False)]
    left = near_dedup.deduplicated(df.withColumn("kept", F.lit("x"))).collect()
    assert sorted((r["doc_id"] or -1, r["kept"]) for r in left) == [(-1, "x"), (1, "x"), (2, "x")]
    # Without an id, and sharing an id, rows are judged each for itself.
    lone = spark.createDataFrame([(None, "q w e r t y"), (None, "q w e r t y"), (None, "u i o p a s"), (5, "f g h j k l"), (5, "z x c v b n")], "doc_id bigint, text string")
    assert sorted(r["text"] for r in near_dedup.deduplicated(lone).collect()) == ["f g h j k l", "q w e r t y", "u i o p a s", "z x c v b n"]


def test_many_short_texts_that_share_words(spark):
    """Lists of very many small sets: nothing is quadratic where nothing can be similar, and blocks stay bounded."""
    near_dedup_rows = spark.range(100_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("one two three four five "), F.floor(F.col("id") / 2)).alias("text"))
    rows = near_dedup.near_duplicates(near_dedup_rows)
    assert rows.filter("component_id <> doc_id - doc_id % 2 or n_shingles <> 2").count() == 0 and rows.count() == 100_000
    texts = [" ".join(["a b c d e f g h i", *(f"w{(k if j else k // 3)}x{j}" for j in range(2))]) for k in range(300)]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(documents(spark, texts)).collect()}
    assert [got[i] for i in range(300)] == brute_components(texts)[1]


@pytest.mark.parametrize("members,shingles", [(7, 10**9), (10**9, 500)])
def test_blocks_of_lists_agree(spark, monkeypatch, members, shingles):
    monkeypatch.setattr(near_dedup, "MEMBERS", members)
    monkeypatch.setattr(near_dedup, "SHINGLES", shingles)
    test_near_duplicates_equal_brute_force(spark, 2)


def test_recall_at_the_threshold(spark):
    """Pairs of a similarity barely above 0.75, each with nothing else in common: all are found."""
    rng = random.Random(4)
    texts = []
    for i in range(400):
        w = [f"p{i}q{k}" for k in range(rng.randint(60, 200))]
        n = len(w) - 4
        for m in range(len(w), 0, -1):  # the longest cut that stays similar
            if 100 * (m - 4) < 75 * n:
                break
        texts += [" ".join(w), " ".join(w[: m + 1])]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(documents(spark, texts)).collect()}
    assert all(got[i] == i - i % 2 for i in range(800))


def test_shared_counts_equal_brute_force():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 60)) ** 2 % 500) for _ in range(90)]
    got = near_dedup._shared(sets[:40], sets[40:])
    assert (got == [[len(np.intersect1d(a, b)) for b in sets[40:]] for a in sets[:40]]).all()


def test_components_of_a_long_path(spark):
    links = spark.range(0, 300).select((F.col("id") * 7 % 301).alias("a"), ((F.col("id") + 1) * 7 % 301).alias("b"))
    assert {r["root"] for r in near_dedup.components(links).collect()} == {0}


def test_overlaps(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    items = [[word() for _ in range(n)] for n in (30, 18, 7, 3, 40)]
    tests = spark.createDataFrame([(i, " ".join(w).capitalize() + ".") for i, w in enumerate(items)] + [(9, None), (8, "")], "item_id bigint, text string")
    fill = lambda n: [word() for _ in range(n)]
    swapped = [word() if k % 5 == 2 else w for k, w in enumerate(items[0])]
    third = [word() if k % 3 == 2 else w for k, w in enumerate(items[4])]
    docs = [fill(50), [*fill(20), *items[0], *fill(9)], [*swapped, *fill(5)], [*fill(3), *items[2]], [*fill(3), *items[3], *fill(30)], [*fill(2), *items[0][5:18], *fill(7)], [*fill(2), *items[0][5:12], *fill(7)], [*items[1], *fill(4), *items[1]], [*fill(10), *third], items[2][:-1]]
    df = documents(spark, [*(", ".join(d) for d in docs), "", None], item_id="clash", word_start=0)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, tests).collect()}
    # Items of three words match nothing; seven words of thirty are too few; two thirds of the words are too few.
    assert got == {(1, 0), (2, 0), (3, 2), (5, 0), (7, 1)}
    places = decontaminate.overlaps(df.filter("doc_id = 7"), tests).orderBy("word_start").collect()
    assert [(r["word_start"], r["word_end"]) for r in places] == [(0, 18), (22, 40)]
    assert {r["doc_id"] for r in decontaminate.clean(df, tests).collect()} == {0, 4, 6, 8, 9, 10, 11}
    assert decontaminate.contaminated(documents(spark, []), tests).count() == 0
    assert decontaminate.contaminated(df, tests.limit(0)).count() == 0


def brute_run(same, min_share):
    """Most matches of any stretch that has the share and from which no stretch with more matches than mismatches goes on."""
    n = len(same)
    most = 0
    for a in range(n):
        for b in range(a + 1, n + 1):
            open_left = any(2 * sum(same[c:a]) > a - c for c in range(a))
            open_right = any(2 * sum(same[b:c]) > c - b for c in range(b + 1, n + 1))
            if not open_left and not open_right and sum(same[a:b]) >= min_share * (b - a) - 1e-9:
                most = max(most, sum(same[a:b]))
    return most


def test_whole_overlaps_equal_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        same = [rng.random() < rng.choice([0.6, 0.75, 0.9]) for _ in range(rng.randint(1, 22))]
        a, b, n = decontaminate.whole_run(np.array(same), 0.7)
        assert n == brute_run(same, 0.7) == sum(same[a:b]) and n >= 0.7 * (b - a) - 1e-9


def brute_overlap(item, words, min_matches=12, min_share=0.7):
    """Most matches of a stretch that counts, on any diagonal of a whole text."""
    most = 0
    for start in range(1 - len(item), len(words)):
        lo, hi = max(start, 0), min(start + len(item), len(words))
        same = np.array([words[k] == item[k - start] for k in range(lo, hi)])
        n = max(decontaminate.best_run(same, min_share)[2], decontaminate.whole_run(same, min_share)[2])
        if n >= decontaminate.least_matches(len(item), min_matches, min_share):
            most = max(most, n)
    return most


def test_overlaps_equal_brute_force(spark):
    """Against all diagonals, with random substitutions: nothing is found that should not be, and of what should be
    found seeds miss hardly any."""
    rng = random.Random(12)
    items = [[f"w{i}x{k}" for k in range(rng.choice([5, 7, 8, 9, 10, 11, 12, 15, 16, 20, 24, 40]))] for i in range(150)]
    texts = []
    for i, item in enumerate(items):
        for _ in range(4):
            changed = set(rng.sample(range(len(item)), rng.randint(0, max(1, int(0.4 * len(item))))))
            begin = rng.choice([0, 0, rng.randrange(len(item))])
            texts.append((i, [*(f"a{rng.randrange(99)}" for _ in range(rng.randint(0, 9))), *("x" if k in changed else w for k, w in enumerate(item))][begin:] + ["b"] * rng.randint(0, 9)))
    docs = documents(spark, [" ".join(w) for _, w in texts])
    tests = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["n_matched"] for r in decontaminate.contaminated(docs, tests).collect()}
    want = {(d, i): n for d, (i, w) in enumerate(texts) if (n := brute_overlap(items[i], w))}
    assert set(got) <= set(want) and all(got[p] <= want[p] for p in got)
    assert len(want) > 300 and len(got) >= 0.98 * len(want)
    short = {p for p in want if len(items[p[1]]) < 16}
    assert short <= set(got)


@pytest.mark.parametrize("size", range(8, 16))
def test_short_items_tolerate_substitutions(spark, size):
    item = [f"w{k}" for k in range(size)]
    few = int(0.3 * size + 1e-9)  # as many as the share allows
    texts = [(n, " ".join([*"abc", *("x" if k in swapped else w for k, w in enumerate(item)), *"def"])) for n in range(few + 2) for swapped in itertools.combinations(range(size), n)]
    docs = documents(spark, [t for _, t in texts])
    tests = spark.createDataFrame([(1, " ".join(item))], "item_id int, text string")
    got = {r["doc_id"]: r["n_matched"] for r in decontaminate.contaminated(docs, tests).collect()}
    assert got == {d: size - n for d, (n, _) in enumerate(texts) if n <= few}


def test_the_filter_may_be_a_bitmap_only(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "FILTER_KEYS", 3)
    monkeypatch.setattr(decontaminate, "FILTER_BITS", 1 << 16)
    monkeypatch.setattr(decontaminate, "SMALL", 3)
    monkeypatch.setattr(decontaminate, "CARRIED", 4)
    test_overlaps(spark)


def test_overlaps_of_odd_ids(spark):
    text = " ".join(f"w{k}" for k in range(20))
    docs = spark.createDataFrame([(1.5, text, "x"), (None, text, "y"), (1.5, "clean", "x"), (2.5, "clean", "z"), (2.5, text + " more", "z")], "doc_id double, text string, row string")
    tests = spark.createDataFrame([("a", text), ("a", text), (None, text), ("b", text.upper())], "item_id string, text string")
    pairs = [(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, tests).collect()]
    assert sorted(map(str, pairs)) == sorted(str((d, i)) for d in (1.5, 2.5, None) for i in ("a", "b", None))
    left = decontaminate.clean(docs, tests).collect()
    assert sorted((r["doc_id"], r["text"]) for r in left) == [(1.5, "clean"), (2.5, "clean")]


LICENSED = [
    "Released under the MIT License.",
    "mit license mit LICENSE mit-license",
    "Licensed under the Apache License, Version 2.0",
    "nothing here",
    "GNU General Public\nLicense and apache license",
    "Permission is hereby granted, free of charge, to any person getting a copy of this software and associated documentation files",
    "Permission is given, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "licensed under CC BY-NC 4.0",
    "License MIT public general",
    "İmit license ımit license mit licensé",
    "",
    None,
    "mit " * 5000 + "license",
]


def test_license_scan(spark):
    got = {r["doc_id"]: r for r in license_scan.scan(documents(spark, LICENSED, words="x", base=1, spans=2)).collect()}
    for i, t in enumerate(LICENSED):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = [(k, label) for p, label in license_scan.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(places), ",".join(sorted({x for _, x in places})))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) or not r["base_labels"]
        assert 0 <= r["score"] <= 1
    # One changed word is tolerated, a changed mandatory phrase is not.
    assert got[5]["labels"] == "mit" and got[5]["n_base"] == 0 and got[6]["labels"] == "" and got[7]["labels"] == "cc-by-nc"
    assert license_scan.license_digest(documents(spark, [])).count() == 0


def brute_spans(words):
    out = set()
    for label, t, keys in license_scan.TEMPLATES:
        t = t.split()
        for start in range(len(words)):
            share = sum(a == b for a, b in zip(words[start : start + len(t)], t, strict=False)) / len(t)
            at = [next(i for i in range(len(t)) if t[i : i + len(k.split())] == k.split()) for k in keys]
            whole = all(words[start + i : start + i + len(k.split())] == k.split() for i, k in zip(at, keys, strict=True))
            if whole and share >= license_scan.COVERAGE - 1e-9:
                out.add((label, start, len(t), round(share, 9)))
    return out


def test_license_templates_equal_brute_force(spark):
    """Notices with words changed, left out at the end, several in one text, among words that notices have as well."""
    rng = random.Random(8)
    vocabulary = sorted({w for _, t, _ in license_scan.TEMPLATES for w in t.split()})
    texts = []
    for _, t, _ in license_scan.TEMPLATES * 6:
        w = t.split()
        for k in rng.sample(range(len(w)), rng.randint(0, license_scan.lost(len(w)) + 1)):
            w[k] = rng.choice([rng.choice(vocabulary), "other"])
        fill = [rng.choices(vocabulary, k=rng.randint(0, 30)) for _ in range(2)]
        texts.append([*fill[0], *w, *fill[1], *(rng.choice(license_scan.TEMPLATES)[1].split() if rng.random() < 0.3 else [])][: rng.choice([None, None, -1])])
    found = 0
    for r in license_scan.scan(documents(spark, [" ".join(t) for t in texts])).collect():
        want = brute_spans(texts[r["doc_id"]])
        assert {(s["label"], s["start"], s["length"], round(s["share"], 9)) for s in r["spans"]} == want
        assert set(r["labels"].split(",")) - {""} == {s[0] for s in want} | (set(r["base_labels"].split(",")) - {""})
        assert r["score"] == pytest.approx(1.0 if r["n_base"] else max((s[3] for s in want), default=0.0))
        found += len(want)
    assert found > 100


def test_license_scan_runs_no_python(spark):
    plan = license_scan.scan(documents(spark, LICENSED))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
