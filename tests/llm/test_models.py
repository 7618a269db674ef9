import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from featurekit.llm import chat, quality, topk_search, toxicity, url_filter


def test_url_filter(spark):
    urls = ["http://Example.ORG/es/x", "https://a.example.org/en/12?x", "https://a.example.org/en/2#t", "ftp://example.com/fr/1", "http://x.com/de/", "http://org/", "http://notorg/", "http://sub.free-bets.net/a", "http://free-bets.net", "no scheme", "", None, "http://", "http://a.org", "http://a.org?x=/es/", "x://y://z/q", "http://a..org/", "http://example.org./es/"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)] * 2, "page_id int, url string, host string").withColumn("rule", F.lit(1))
    rules = url_filter.RULES
    got = {r["page_id"]: r for r in url_filter.judge(df, rules, url_filter.listed_hosts(df)).collect()}
    assert url_filter.judge(df, rules, url_filter.listed_hosts(df)).count() == 2 * len(urls)
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
        fits = [(h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, None))
        bad = any(t in label.split("-") for label in host.split(".") for t in url_filter.TERMS)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), u
        assert got[i]["verdict"] == (verdict or ("block" if bad else "allow")), u
    empty = url_filter.judge(df.limit(0), rules, url_filter.listed_hosts(df.limit(0)))
    assert empty.count() == 0
    assert url_filter.judge(df, [], url_filter.listed_hosts(df).limit(0)).filter("verdict <> 'allow' or rule is not null").count() == 0


def test_cascade_is_exact(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "LEAST_BITS", 64)
    monkeypatch.setattr(url_filter, "SPARE_BITS", 1)  # many false positives, hence many levels
    universe = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.filter("crc32(key) % 7 = 0")
    for size in (None, 40, 10**9):  # a wrong guess changes levels, not answers
        cascade = url_filter.build(listed, universe.union(universe), size)
        assert len(cascade.levels) > 2 or size == 10**9
        assert universe.filter(cascade.holds(F.col("key")) != (F.crc32("key") % 7 == 0)).count() == 0


def test_a_million_hosts_and_many_rules(spark):
    """Neither a join of pages nor Python is in the plan, and every answer is right."""
    rules = [(f"h{i}.net", f"/{'ab'[i % 2]}{i % 5}/", "block" if i % 3 == 0 else "allow") for i in range(20_000)]
    df = spark.range(4000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://x.h"), F.col("id") * 7, F.lit(".net/"), F.when(F.col("id") % 2 == 0, "a").otherwise("b"), F.col("id") % 5, F.lit("/")).alias("url"))
    listed = spark.range(1_000_000).select(F.concat(F.lit("h"), F.col("id") * 5, F.lit(".net")).alias("key"))
    judged = url_filter.judge(df, rules, listed)
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Join", "Python", "Arrow", "Pandas", "Exchange"))
    known = {h + p: v for h, p, v in rules}
    for r in judged.collect():
        i, n = r["page_id"], r["page_id"] * 7
        rule = f"h{n}.net/{'ab'[i % 2]}{i % 5}/"
        rule = rule if rule in known else None
        assert (r["rule"], r["verdict"]) == (rule, known[rule] if rule else "block" if n % 5 == 0 and n < 5_000_000 else "allow")


def test_a_filter_beyond_its_bound_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MOST_BITS", 1 << 16)
    with pytest.raises(ValueError, match="MOST_BITS"):
        url_filter.build(spark.range(40_000).select(F.col("id").cast("string").alias("key")), spark.range(9).select(F.col("id").cast("string").alias("key")))


def labelled(spark, n=900, seed=5):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        w = rng.choices(words, k=rng.randint(20, 150))
        good, toxic = rng.random() < 0.7, rng.random() < 0.3
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["vilefool", "vilest", "grimblot"]) + rng.choice(["", "s", "en", "isch"])
        text = " ".join(w) if good else rng.choice([" | ".join(w), " ".join(f"{x}$$$" for x in w), " ".join(w).upper(), " ".join(x for x in w for _ in range(9))])
        docs.append((i, text, "src"))
        labels.append((i, int(good), int(toxic)))
    return spark.createDataFrame(docs, "doc_id bigint, text string, score string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize("module,label,modulus,held", [(quality, "quality", 5, 0), (toxicity, "toxic", 3, 1)])
def test_held_out_accuracy(spark, module, label, modulus, held):
    docs, labels = labelled(spark)
    odd = spark.createDataFrame([(5000, None, "x"), (5001, "", "x"), (5002, "word " * 60000, "x"), (None, "abc", "x"), (0, "again", "x")], docs.schema)
    rows = module.score(docs.union(odd), labels).collect()
    assert len(rows) == 905 and all(0 <= r["score"] <= 1 for r in rows)
    truth = {r["doc_id"]: r[label] for r in labels.collect()}
    mine = [r for r in rows if r["doc_id"] in truth and r["doc_id"] != 0 and r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == held) for r in rows if r["doc_id"] is not None)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in mine]) > 0.97
    assert module.score(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in module.score(docs, labels.limit(0)).collect()} <= {0.5, 0.0}


def test_held_out_labels_are_not_learnt(spark):
    docs, labels = labelled(spark, 300)
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, quality.score(docs, x).collect())) for x in (labels, flipped))
    assert a == b


def test_nearest_examples_are_exact():
    rng = np.random.default_rng(2)
    names = [f"t{i:02d}" for i in range(40)]
    examples = [(i, int(rng.random() < 0.4), {names[k]: int(rng.integers(1, 4)) for k in rng.choice(40, rng.integers(0, 6), replace=False)}) for i in range(700)]
    df = {t: sum(t in c for _, _, c in examples) for t in names}
    index = toxicity.build(examples, df, len(examples))
    dense = np.zeros((700, 40))
    for i, (_, _, counts) in enumerate(examples):
        t, w = index.vector({index.ids[x]: n for x, n in counts.items()})
        dense[i, t] = w
    for _ in range(50):
        counts = {int(k): int(rng.integers(1, 4)) for k in rng.choice(40, rng.integers(1, 6), replace=False)}
        t, w = index.vector(counts)
        cosine = (dense[:, t] @ w).round(9)
        want = sorted((-s, i) for i, s in enumerate(cosine) if s > 0)[: toxicity.NEIGHBOURS]
        got = index.nearest(counts)
        assert [i for _, i in got] == [i for _, i in want]
        assert [s for s, _ in got] == pytest.approx([-s for s, _ in want])


def test_every_text_meets_examples(spark):
    """Texts whose words say nothing about toxicity, too, and however few examples there are."""
    rng = random.Random(9)
    texts = [" ".join(f"{rng.choice('abcdefgh')}{k % 40}x".replace("0", "o") for k in rng.sample(range(400), 30)) + f" plain{'abcdefghij'[i % 10]}" for i in range(120)]
    docs = spark.createDataFrame([(i, t + (" venom" if i % 4 == 0 else "")) for i, t in enumerate(texts)], "doc_id bigint, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    for size in (24, 120):
        rows = toxicity.score(docs.filter(F.col("doc_id") < size), labels.filter(F.col("doc_id") < size)).collect()
        assert all(len(r["neighbours"]) > 0 and 0 < len(r["evidence"]) <= toxicity.EVIDENCE for r in rows)


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    codes = rng.integers(-(2**63), 2**63, 600, dtype=np.int64)
    codes[100:350] = codes[5]  # a vector that very many rows have
    codes[400:420] = codes[6] ^ (1 << np.arange(20))
    rows = [(i, int(c), "x") for i, c in enumerate(codes)]
    df = spark.createDataFrame([*rows, rows[3], (None, 5, "x"), (7777, None, "x")], "vec_id bigint, code bigint, rank string")
    got = {}
    for r in topk_search.top_k(df, df.filter("vec_id % 20 = 0"), 10).collect():
        got.setdefault(r["vec_id"], []).append((r["rank"], r["distance"], r["neighbour"]))
    for q in range(0, 600, 20):
        d = np.bitwise_count((codes ^ codes[q]).view(np.uint64))
        want = sorted((int(d[i]), i) for i in range(600) if i != q)[:10]
        assert [(x, i) for _, x, i in sorted(got[q])] == want
    assert topk_search.top_k(df.limit(0), df.limit(0)).count() == 0
    assert topk_search.top_k(df.limit(3), df.limit(1), 10).count() == 2


def test_codes_apart(spark):
    """Far neighbours, for which radii must grow; a segment's value that most codes share; strings as ids."""
    rng = np.random.default_rng(7)
    codes = rng.integers(-(2**63), 2**63, 3000, dtype=np.int64)
    codes[500:2000] = (codes[500:2000] & ~0xFFFF) | 0x1234
    df = spark.createDataFrame([(f"v{i:05d}", int(c)) for i, c in enumerate(codes)], "vec_id string, code bigint")
    got = {}
    for r in topk_search.top_k(df, df.filter("vec_id like '%00'"), 5).collect():
        got.setdefault(r["vec_id"], []).append((r["rank"], r["distance"], r["neighbour"]))
    for q in range(0, 3000, 100):
        d = np.bitwise_count((codes ^ codes[q]).view(np.uint64))
        want = sorted((int(d[i]), f"v{i:05d}") for i in range(3000) if i != q)[:5]
        assert [(x, i) for _, x, i in sorted(got[f"v{q:05d}"])] == want


def test_search_runs_no_python(spark):
    df = spark.range(50).select(F.col("id").alias("vec_id"), F.col("id").alias("code"))
    plan = topk_search.top_k(df, df)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_sign_code(spark):
    v = [1.0 if i in (0, 63) else -1.0 for i in range(64)]
    df = spark.createDataFrame([(v,), ([1.0],), (None,)], "v array<float>")
    assert [r[0] for r in df.select(topk_search.sign_code(F.col("v"))).collect()] == [1 - 2**63, 1, 0]


def brute_viterbi(model, lines):
    score = model.start + model.emission(lines[0][3][:3])
    back = []
    for _, n, _, f in lines[1:]:
        to = score[:, None] + model.steps[chat._kind(n == 0, f)]
        back.append(to.argmax(0))
        score = to.max(0) + model.emission(f[:3])
    best = int((score + model.end).argmax())
    out = [best]
    for b in back[::-1]:
        best = int(b[best])
        out.append(best)
    return out[::-1]


def conversations(spark, extra=()):
    rng = random.Random(6)
    rows = []
    for conv in range(60):
        roles = (["system"] if rng.random() < 0.3 else []) + ["user", "assistant"] * rng.randint(1, 5)
        for turn, role in enumerate(roles):
            n = {"system": 30, "user": 8, "assistant": 60}[role]
            rows.append((conv, turn, role, " ".join("word" for _ in range(rng.randint(1, n))) + ("?" if role == "user" and rng.random() < 0.6 else ".")))
    return spark.createDataFrame([*rows, *extra], "conv_id bigint, turn bigint, role string, text string")


def test_chat_roles(spark, monkeypatch):
    turns = conversations(spark, [(70, 0, None, "System: be brief\nUser: what is it?\nAssistant: a thing\nand more"), (71, 0, "user", None), (71, 1, "x", ""), (None, 0, "user", "a"), (72, None, "user", "a"), (0, 0, "user", "same place"), (73, 0, "user", "a"), (73, 0, "user", "a")])
    model = chat.learn(turns)
    rows = chat.format_chats(turns.withColumn("rendered", F.lit("clash")), model).collect()
    truth = {(r["conv_id"], r["turn"]): r["role"] for r in turns.filter("conv_id < 60 and conv_id > 0").collect()}
    assert np.mean([truth[r["conv_id"], r["turn"]] == r["role"] for r in rows if (r["conv_id"], r["turn"]) in truth]) > 0.85
    marked = [r for r in sorted(rows, key=lambda r: (r["conv_id"], r["turn"], r["line"])) if r["conv_id"] == 70]
    assert [r["role"] for r in marked] == ["system", "user", "assistant", "assistant"]
    assert "".join(r["rendered"] for r in marked) == "<|system|>\nbe brief\n<|end|>\n<|user|>\nwhat is it?\n<|end|>\n<|assistant|>\na thing\nand more\n<|end|>\n"
    assert sum(r["conv_id"] == 73 for r in rows) == 1
    assert chat.format_chats(turns.limit(0), model).count() == 0
    whole = sorted(map(tuple, rows))
    monkeypatch.setattr(chat, "BLOCK", 2)
    assert sorted(map(tuple, chat.format_chats(turns.withColumn("rendered", F.lit("clash")), model).collect())) == whole


def test_blocks_give_the_path_of_one_viterbi(spark, monkeypatch):
    turns = conversations(spark)
    model = chat.learn(turns)
    rng = random.Random(8)
    long = [(1, t, "user", f"{'w' * rng.randint(1, 300)}{rng.choice(['?', '.'])}") for t in range(400)]
    monkeypatch.setattr(chat, "BLOCK", 37)
    got = chat.format_chats(spark.createDataFrame(long, turns.schema), model).orderBy("turn", "line").collect()
    want = brute_viterbi(model, chat._lines([x[3] for x in long]))
    assert [chat.ROLES.index(r["role"]) for r in got] == want


def test_learning_from_nothing(spark):
    turns = conversations(spark).limit(0)
    assert chat.format_chats(conversations(spark), chat.learn(turns)).count() == conversations(spark).count()
