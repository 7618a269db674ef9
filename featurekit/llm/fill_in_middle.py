"""Fill-in-the-middle (operator 13): a text's units (lines, unless told otherwise) are cut into prefix, middle and suffix
and put in another order behind sentinels, so that a left-to-right model learns to fill gaps.

An Arrow-batched pandas function gathers the end of every unit in a compact array; two lookups there give the cuts, and
hashlib draws them from the document's id, so that a lost task makes the same text again. Nothing is shuffled."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from featurekit.llm.common import free_name, plainly_named

#: Units: lines with their ends.
LINES = r"[^\n]*\n|[^\n]+"
#: What stands before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Columns that this operator adds.
ADDED = ["n", "form", "prefix_chars", "middle_chars", "output"]
_MADE = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


def draws(seed: int, doc_id: str | None) -> list[int]:
    """Four 32-bit numbers of a document. A missing id counts as an empty one."""
    digits = hashlib.sha256(f"{seed}:{doc_id or ''}".encode()).hexdigest()
    return [int(digits[i : i + 8], 16) for i in range(0, 32, 8)]


def check_sentinels(sentinels: tuple[str, str, str]) -> None:
    """Sentinels must differ, be no part of one another, and not begin as they end: then each is found where it was put."""
    if any(a in b for i, a in enumerate(sentinels) for j, b in enumerate(sentinels) if i != j) or not all(sentinels):
        raise ValueError("sentinels must not be empty, nor one a part of another")
    if any(s[:k] == s[-k:] for s in sentinels for k in range(1, len(s))):
        raise ValueError("a sentinel must not begin as it ends")


def transformed(
    text: str, numbers: list[int], units: regex.Pattern, rate: int, spm: int, sentinels: tuple[str, str, str]
) -> tuple[int, str, int | None, int | None, str]:
    """Number of units, form, lengths of prefix and middle, and output of one text."""
    ends = array("Q", (m.end() for m in units.finditer(text)))
    n = len(ends)
    if not text or numbers[2] % 100 >= rate or any(s in text for s in sentinels):
        return n, "plain", None, None, text
    low, high = sorted((numbers[0] % (n + 1), numbers[1] % (n + 1)))
    a, b = (ends[low - 1] if low else 0), (ends[high - 1] if high else 0)
    at_prefix, at_suffix, at_middle = sentinels
    if numbers[3] % 100 < spm:
        return n, "spm", a, b - a, f"{at_suffix}{text[b:]}{at_prefix}{text[:a]}{at_middle}{text[a:b]}"
    return n, "psm", a, b - a, f"{at_prefix}{text[:a]}{at_suffix}{text[b:]}{at_middle}{text[a:b]}"


def restored(output: str, form: str, sentinels: tuple[str, str, str] = SENTINELS) -> str:
    """The text that an output was made of."""
    if form == "plain":
        return output
    at_prefix, at_suffix, at_middle = sentinels
    first, second = (at_suffix, at_prefix) if form == "spm" else (at_prefix, at_suffix)
    one, _, rest = output.removeprefix(first).partition(second)
    two, _, middle = rest.partition(at_middle)
    return two + middle + one if form == "spm" else one + middle + two


def fill_in_middle(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    *,
    seed: int = 7,
    rate: int = 100,
    spm: int = 50,
    units: str = LINES,
    sentinels: tuple[str, str, str] = SENTINELS,
) -> DataFrame:
    """The rows with ``n`` (units), ``form`` (plain, psm or spm), ``prefix_chars`` and ``middle_chars`` (code points, null
    if plain) and ``output``; columns of these names that the rows have are replaced, all others stay.

    ``rate`` per cent of the documents are transformed, ``spm`` per cent of these with the suffix first. Null texts count
    as empty ones, which stay plain, as do texts that contain a sentinel. A null id is drawn for as an empty one. Rows of
    one id and text give equal outputs. Characters that no unit covers fall to what stands before the next unit's end;
    after the last, to the suffix. An empty table gives an empty one."""
    check_sentinels(sentinels)
    pattern = regex.compile(units)

    @pandas_udf(_MADE)
    def make(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ids, texts in batches:
            rows = [
                transformed(t, draws(seed, i), pattern, rate, spm, sentinels) for i, t in zip(ids, texts, strict=True)
            ]
            made = pd.DataFrame(rows, columns=ADDED)
            yield made.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    plain = plainly_named(docs)
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    kept = [c for c in docs.columns if c.lower() not in ADDED]
    made = free_name(plain, "made")
    out = plain.withColumn(
        made, make(F.coalesce(F.col(at[id_col]).cast("string"), F.lit("")), F.coalesce(F.col(at[text_col]), F.lit("")))
    )
    return out.select(*(at[c] for c in kept), *(F.col(made)[c] for c in ADDED)).toDF(*kept, *ADDED)


def digests(filled: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """The rows with SHA-256 digests of the output, and of the text rebuilt from output and form alone, in its place."""

    @pandas_udf("output_sha256 string, restored_sha256 string")
    def digest(outputs: pd.Series, forms: pd.Series) -> pd.DataFrame:
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        rows = [(sha(o), sha(restored(o, f, sentinels))) for o, f in zip(outputs, forms, strict=True)]
        return pd.DataFrame(rows, columns=["output_sha256", "restored_sha256"], dtype=object)

    kept = [c for c in filled.columns if c != "output"]
    return filled.withColumn("_digest", digest("output", "form")).select(*kept, "_digest.*")


def document_digest(docs: DataFrame) -> DataFrame:
    """Units, form, lengths and digests of every document."""
    made = fill_in_middle(docs.select("doc_id", "text")).select("doc_id", *ADDED)
    return digests(made)


#: The same rows.
SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, x, regexp_extract_all(x, '[^\n]*\n|[^\n]+') AS ls, CAST('0x' || h[1:8] AS BIGINT) AS h1,
  CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
c AS (SELECT *, len(ls) AS n, least(h1 % (len(ls) + 1), h2 % (len(ls) + 1)) AS lo,
  greatest(h1 % (len(ls) + 1), h2 % (len(ls) + 1)) AS hi,
  CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') THEN 'plain'
    WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, CASE WHEN lo = 0 THEN '' ELSE array_to_string(ls[1:lo], '') END AS a,
  CASE WHEN hi = lo THEN '' ELSE array_to_string(ls[lo + 1:hi], '') END AS m,
  CASE WHEN hi = n THEN '' ELSE array_to_string(ls[hi + 1:n], '') END AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(a) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || a || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || a || '<M>' || m END) AS output_sha256, sha256(x) AS restored_sha256 FROM p
"""
