"""License scans (operator 7): a positional index of licence templates by their rarest words. A file's rare licence words
are looked up, postings that agree on where the template begins are intersected, and mandatory phrases are verified."""

from __future__ import annotations

import json
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases whose every place counts, with their label.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Templates: label, words of the notice, and phrases of it that must stand there. Public licence notices, fixed values.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted", "free of charge"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("apache", "licensed under the apache license version 2 0", ["apache license"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ["general public license"]),
    ("gpl", "licensed under the gnu general public license version 3", ["general public license"]),
    ("lgpl", "under the terms of the gnu lesser general public license", ["lesser general public license"]),
    ("agpl", "under the terms of the gnu affero general public license", ["affero general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["source and binary forms"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", ["mozilla public license"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software"]),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ["substantial portions of the software"]),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ["apache org licenses"]),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["endorse or promote products"]),
    ("boost", "distributed under the boost software license version 1 0", ["boost software license"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ["held liable for any damages"]),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", ["eclipse public license"]),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("artistic", "under the terms of the artistic license 2 0", ["artistic license"]),
]
#: Tags "spdx license identifier ..." by label, as words.
SPDX = {"mit": "mit", "apache": "apache 2 0", "gpl": "gpl 3 0", "lgpl": "lgpl 3 0", "agpl": "agpl 3 0", "bsd": "bsd 3 clause", "isc": "isc", "mpl": "mpl 2 0", "epl": "epl 2 0", "boost": "bsl 1 0", "zlib": "zlib", "cc0": "cc0 1 0", "unlicense": "unlicense"}
TEMPLATES += [(label, f"spdx license identifier {tag}", [f"spdx license identifier {tag}"]) for label, tag in SPDX.items()]

#: The share of a template's words that must stand in place.
COVERAGE = 0.8
_LIMIT = 64  # a place of a phrase is coded as start * _LIMIT + its number


def words_of(text: Column) -> Column:
    """Runs of digits, a-z and characters beyond ASCII. Lower-casing other letters too neither cuts nor joins a word."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def idf(rows: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """Inverse document frequencies of the licence vocabulary over all rows (column words)."""
    found = F.array_intersect(F.col("words"), _strings(vocabulary))
    counts = {r["w"]: r["df"] for r in rows.select(F.explode(F.concat(found, F.array(F.lit("")))).alias("w")).groupBy("w").agg(F.count("*").alias("df")).collect()}  # the vocabulary at most
    n = counts.get("", 0)
    return {w: math.log((n + 1) / (counts.get(w, 0) + 1)) for w in vocabulary}


def rarest(words: list[str], weight: dict[str, float], most: int) -> list[int]:
    """Positions of the template's rarest words, each word once; ties go to the earlier place."""
    first = {w: i for i, w in reversed(list(enumerate(words)))}
    return [first[w] for w in sorted(first, key=lambda w: (-weight[w], first[w]))[:most]]


def lost(n: int) -> int:
    """Words of a template of ``n`` that need not stand in place."""
    return int((1 - COVERAGE) * n + 1e-9)


def index(templates: list[tuple[str, str, list[str]]], weight: dict[str, float]) -> list[dict]:
    """The positional index: of each template its words, rarest first, with their positions; how many of them may be
    missing from a file; and how many of the file's rarest are looked up. Two of these must agree on where the template
    begins: of ``lost`` + 2 words that many stand in place wherever enough words do, so nothing that counts is missed."""
    out = []
    for label, text, keys in templates:
        t = text.split()
        words = [t[i] for i in rarest(t, weight, len(t))]
        phrases = [k.split() for k in keys]
        out.append({
            "label": label,
            "text": t,
            "words": words,
            "postings": [{"w": w, "at": [i for i, x in enumerate(t) if x == w]} for w in words],
            "least": len(words) - lost(len(t)),
            "anchors": lost(len(t)) + 2,
            "keys": [{"at": next(i for i in range(len(t)) if t[i : i + len(k)] == k), "text": k} for k in phrases],
        })
    return out


_INDEX = "array<struct<label string, text array<string>, words array<string>, postings array<struct<w string, at array<int>>>, least int, anchors int, keys array<struct<at int, text array<string>>>>>"


def _codes(words: Column, anchors: list[tuple[int, str, int]]) -> Column:
    """Places of phrases that the anchors (number, word, position) give: where each would begin."""
    hits = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda h: h["w"].isin([w for _, w, _ in anchors]))

    def of(t: int, word: str, q: int) -> Column:
        return F.transform(F.filter(hits, lambda h: (h["w"] == word) & (h["i"] >= q)), lambda h: (h["i"] - q).cast("bigint") * _LIMIT + t)

    return F.array_distinct(F.concat(*(of(*a) for a in anchors)))


def _with(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _starts(t: Column, hits: Column, known: Column) -> Column:
    """Where the postings of at least two of the file's rarest words of a template agree that it begins."""
    chosen = F.slice(F.filter(t["postings"], lambda a: F.array_contains(known, a["w"])), 1, t["anchors"])
    places = lambda a: F.flatten(F.transform(F.filter(hits, lambda h: h["w"] == a["w"]), lambda h: F.transform(a["at"], lambda q: h["i"] - q)))
    all_ = F.array_sort(F.flatten(F.transform(chosen, lambda a: F.array_distinct(places(a)))))
    twice = lambda s: F.filter(s, lambda x, i: (i > 0) & (x >= 0) & (F.get(s, i - 1) == x))
    return F.array_distinct(_with(all_, twice))


def _span(t: Column, words: Column, start: Column) -> Column:
    """The template at a place: label, start, length and the share of its words there, 0 where a mandatory phrase is not."""
    whole = F.forall(t["keys"], lambda k: F.slice(words, start + 1 + k["at"], F.size(k["text"])) == k["text"])
    there = F.size(F.filter(F.arrays_zip(F.slice(words, start + 1, F.size(t["text"])).alias("a"), t["text"].alias("b")), lambda z: z["a"].eqNullSafe(z["b"])))
    return F.struct(t["label"].alias("label"), start.alias("start"), F.size(t["text"]).alias("length"), F.when(whole, there / F.size(t["text"])).otherwise(0.0).alias("share"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    n_base counts the places of ``PHRASES``, first_word and last_word are the smallest and largest of them (words from 0),
    null without any. labels has those of the templates too; spans has label, start, length and share of every template
    of which ``COVERAGE`` of the words stand in place, its mandatory phrases whole; all such places are found. score is
    the largest share, 1 where a phrase stands. Null and empty texts have no words, empty labels and score 0. Repeated
    rows and ids each have their row; other columns are not read. The whole text is read; the only shuffle sums the
    licence vocabulary's document frequencies."""
    rows = docs.select(F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("words"))
    phrases = [(p.split(), label) for p, label in PHRASES.items()]
    vocabulary = sorted({w for t, _ in phrases for w in t} | {w for _, t, _ in TEMPLATES for w in t.split()})
    weight = idf(rows, vocabulary)
    held = F.from_json(F.lit(json.dumps(index(TEMPLATES, weight))), _INDEX)  # folded to a literal

    single = [(k, t[q], q) for k, (t, _) in enumerate(phrases) for q in rarest(t, weight, 1)]
    words = F.col("words")
    start = lambda c: F.floor(c / _LIMIT).cast("int")
    label = lambda c: F.element_at(_strings([n for _, n in phrases]), (c % _LIMIT + 1).cast("int"))
    stands = lambda c, phrase: F.slice(words, start(c) + 1, len(phrase)) == _strings(phrase)
    base = F.filter(F.col("base_codes"), lambda c: reduce(Column.__or__, [((c % _LIMIT) == k) & stands(c, t) for k, (t, _) in enumerate(phrases)]))

    rows = rows.withColumn("known", F.array_intersect(_strings(vocabulary), words))
    may = F.filter(held, lambda t: F.size(F.array_intersect(t["words"], F.col("known"))) >= t["least"])
    rows = rows.withColumns({"may": may, "base_codes": F.when(F.arrays_overlap("known", _strings(sorted({w for _, w, _ in single}))), _codes(words, single)).otherwise(F.array().cast("array<bigint>"))})
    # Places of the words of templates that the file may hold.
    hits = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda h: F.exists("may", lambda t: F.array_contains(t["words"], h["w"])))
    rows = rows.withColumns({"base": base, "hits": F.when(F.size("may") > 0, hits)})
    spans = F.flatten(F.transform("may", lambda t: F.transform(_starts(t, F.col("hits"), F.col("known")), lambda s: _span(t, words, s))))
    rows = rows.withColumn("spans", F.filter(spans, lambda s: s["share"] >= COVERAGE - 1e-9))
    base_labels = F.array_sort(F.array_distinct(F.transform("base", label)))
    all_labels = F.array_sort(F.array_union(base_labels, F.transform("spans", lambda s: s["label"])))
    score = F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)))
    return rows.select(
        F.col("id").alias(id_col),
        F.size("words").cast("long").alias("n_words"),
        F.size("base").cast("long").alias("n_base"),
        start(F.array_min("base")).cast("long").alias("first_word"),
        start(F.array_max("base")).cast("long").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(all_labels, ",").alias("labels"),
        score.alias("score"),
        "spans",
    )


def license_digest(docs: DataFrame) -> DataFrame:
    return scan(docs).drop("spans")
