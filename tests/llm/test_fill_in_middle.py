"""Fill-in-the-middle by a plain rewriting of the rule, and by restoring."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from featurekit.llm import fill_in_middle as fim

TEXTS = [None, "", "\n", "a", "a\nb", "a\nb\n", "\n\n\n", "é日\r\nx\r\ny\n", "x<P>y\nz", "a\n<M>", "<S", "<S\n>P>\n<\nM>\n", "line\n" * 5000, "w" * 300_000, "𝄞\n𝄞𝄞\nz", "x\x00\n\x85y z\n"]


def plainly(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(lines)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    low, high = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    p, m, s = "".join(lines[:low]), "".join(lines[low:high]), "".join(lines[high:])
    if h4 % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("options", [{}, {"rate": 40, "spm": 90, "seed": 11}])
def test_rows_equal_the_plain_rule(spark, options):
    rows = [(i * 7 + k, t) for k in range(7) for i, t in enumerate(TEXTS)] + [(None, "a\nb\nc"), (None, "a\nb\nc"), (3, "twice\nx"), (3, "twice\nx")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"FORM": F.lit("x"), "output": F.lit(1), "a.b": F.lit(2)})
    got = fim.fill_in_middle(df, **options)
    assert got.columns == ["doc_id", "text", "a.b", *fim.ADDED]
    found = got.collect()
    key = lambda r: (str(r[0]), str(r[1]))
    for (i, t), r in zip(sorted(rows, key=key), sorted(found, key=key), strict=True):
        assert tuple(r[c] for c in fim.ADDED) == plainly(i, t, **options)
        assert fim.restored(r["output"], r["form"]) == (t or "")
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}


def test_digests(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in fim.document_digest(df).collect():
        text = TEXTS[r["doc_id"]]
        assert (r["output_sha256"], r["restored_sha256"]) == (sha(plainly(r["doc_id"], text)[4]), sha(text or ""))
    assert fim.document_digest(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_other_units_and_sentinels(spark):
    """Units that leave characters out at the end, and sentinels that could not be told apart."""
    df = spark.createDataFrame([(i, "one two, three four;") for i in range(40)], "id int, body string")
    marks = ("[pre]", "[suf]", "[mid]")
    rows = fim.fill_in_middle(df, "body", "id", units=r"\w+\W*?(?=\w|$)", sentinels=marks).collect()
    assert all(fim.restored(r["output"], r["form"], marks) == "one two, three four;" for r in rows) and len({r["output"] for r in rows}) > 5
    for bad in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("<P>", "<P>x", "<M>"), ("aba", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(df, "body", "id", sentinels=bad)
