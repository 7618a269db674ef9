import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from featurekit.llm import common, quality, toxicity
from tests.llm.test_text_operators import brute_components, brute_overlap

ODD = [(None, "a word of its own that no other row has at all"), (None, None), (7, ""), (7, "same id and another text than the others here"), (8, "twice the same row in one table"), (8, "twice the same row in one table")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents of two qualities, with insults, near copies, benchmark passages and odd rows, in a folder."""
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    items = [" ".join(f"q{i}w{k}" for k in range(20)) for i in range(5)]
    docs, labels = [], []
    for i in range(100, 500):
        good, toxic = rng.random() < 0.7, rng.random() < 0.25
        text = prose(rng.randint(30, 120)) + (" vilefool grimblot" if toxic else "")
        text = text if good else " | ".join(f"{x}$$$" for x in text.split())
        if i % 29 == 0:
            text += " " + items[i % 5]
        if i % 31 == 0 and docs:
            text = docs[-1][1] + " more"
            good, toxic = labels[-1][1], labels[-1][2]
        docs.append((i, text))
        labels.append((i, int(good), int(toxic)))
    folder = str(tmp_path_factory.mktemp("tables"))
    df = spark.createDataFrame([*docs, *ODD], "doc_id bigint, text string")
    df = df.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long"), "row": F.lit("x"), "kept": F.lit(1)})
    df.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([*enumerate(items), (9, None)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def rows(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_stages_equal_brute_force(spark, tables):
    """Each stage on what the one before kept, its decisions by row; columns of documents stay."""
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    known = {r["doc_id"]: r for r in labels.collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    learn = sorted(i for i in known if zlib.crc32(str(i).encode()) % 5)
    model = quality.fit([texts[i] for i in learn], [known[i]["quality"] for i in learn])

    stage = dict(corpus_pipeline.STAGES)
    kept = common.materialize(stage["quality"](spark, docs, tables))
    assert kept.columns == docs.columns
    assert rows(kept) == sorted(((r["doc_id"], r["text"]) for r in docs.collect() if model.scores([r["text"]])[0] >= 0.3), key=repr)

    learn = [i for i in sorted(known) if zlib.crc32(str(i).encode()) % 3 != 1 and i in {r["doc_id"] for r in kept.collect()}]
    counted = [(i, known[i]["toxic"], toxicity.term_counts(texts[i])) for i in learn]
    index = toxicity.build(counted, {}, 0)
    rates = index.rates(index.own_votes(list(range(len(learn)))))
    scorer = toxicity.Scorer(index, rates)
    want = sorted(((r["doc_id"], r["text"]) for r in kept.collect() if scorer([r["text"]])[0][0] < 0.7), key=repr)
    kept = common.materialize(stage["toxicity"](spark, kept, tables))
    assert rows(kept) == want and np.mean(["vilefool" in (t or "") for _, t in want]) < 0.02

    before = rows(kept)
    kept = common.materialize(stage["near_dedup"](spark, kept, tables))
    _, roots = brute_components([t for _, t in before])
    groups = {}
    for (i, t), root in zip(before, roots, strict=True):
        groups.setdefault(root, []).append((i is None, i or 0, t or ""))
    left = {(i is None, i or 0, t or "") for i, t in rows(kept)}
    assert left == {min(g) for g in groups.values()} and len(rows(kept)) == len(left)

    before = rows(kept)
    kept = common.materialize(stage["decontamination"](spark, kept, tables))
    items = [re.findall(r"\w+", r["text"]) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect() if r["text"]]
    assert rows(kept) == [r for r in before if not any(brute_overlap(i, re.findall(r"\w+", r[1] or "")) for i in items)]
    assert len(rows(kept)) < len(before) and kept.columns == docs.columns

    before = rows(kept)
    pieces = stage["packing"](spark, kept, tables).collect()
    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode
    for i, t in before:
        if i is not None and sum(x == i for x, _ in before) == 1:
            assert sum(p["length"] for p in pieces if p["doc_id"] == i) == len(encode(t or "", add_special_tokens=False).ids) + 1


def test_run_equals_its_stages_and_leaves_little(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = common.materialize(stage(spark, docs, tables))
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["start"], r["length"], r["ids_crc32"])
    with common.collected() as written:
        got = corpus_pipeline.run(spark, tables).collect()
    assert sorted(map(key, got), key=repr) == sorted(map(key, docs.collect()), key=repr)
    assert sum(x in common._WRITTEN for x in written) == 1


def test_empty_tables(spark, tables, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_no_shared_folder_is_an_error(spark, monkeypatch):
    class Elsewhere:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"getCheckpointDir": staticmethod(lambda: None), "master": "spark://host:7077"})

    with pytest.raises(RuntimeError, match="checkpoint"):
        common.scratch_dir(Elsewhere)
