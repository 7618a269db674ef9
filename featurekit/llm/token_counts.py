"""Token counts (operator 6): pieces are counted once per distinct pre-token and joined to per-document frequencies."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache, cached_property
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from featurekit.llm.common import materialize, plainly_named, slices

#: The most frequent pre-tokens, that many at most, whose counts every worker has; others meet theirs by a join.
FREQUENT = 500_000
#: Distinct pre-tokens that a task gathers before it passes their frequencies on.
GATHERED = 300_000
BATCH = 256

#: A run of blanks with the word or line break after it, or blanks at the end.
_UNITS = re.compile("[ ▁]*(?:[^ ▁\n]+|\n)|[ ▁]+").findall
_SIMPLE = re.compile(" [^ ▁\n]+").fullmatch


@cache
def _model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@cache
def _separable(path: str) -> tuple[bool, bool]:
    """Whether no piece has a blank after another character (texts may be cut before blanks), and whether none holds a
    line break (texts may be cut around them); both only for a model that leaves texts as they are."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    n = m.normalizer_spec
    plain = n.name == "identity" and n.add_dummy_prefix and n.escape_whitespaces and not n.remove_extra_whitespaces and not m.trainer_spec.treat_whitespace_as_suffix
    pieces = [p.piece for p in m.pieces if p.type in (1, 4, 5)]
    plain = plain and m.trainer_spec.model_type == 2 and not any(p.type == 4 for p in m.pieces)
    return plain and not any(re.search("[^▁]▁", p) for p in pieces), not any("\n" in p for p in pieces)


def pre_tokens(text: str) -> list[str]:
    """Units no piece spans. The first blank of a text is the one the library puts before it."""
    return _UNITS(" " + text)


@cache
def _starts(path: str) -> np.ndarray:
    """By id: whether its piece begins with a blank."""
    m = _model(path)
    return np.array([m.id_to_piece(i).startswith("▁") for i in range(m.get_piece_size())])


def _count(path: str, units: list[str]) -> list[int]:
    """Pieces of each unit. Units of one blank and a word are encoded many to a text, where exactly the first piece of
    each begins with a blank; others alone, after a line break, which stands alone as the library's blank before it."""
    model, out = _model(path), dict.fromkeys(units, 0)
    plain = [u for u in units if _SIMPLE(u)]
    for i in range(0, len(plain), 1000):
        part = plain[i : i + 1000]
        ids = np.array(model.encode("".join(part)[1:], num_threads=1))
        at = np.flatnonzero(_starts(path)[ids])
        out.update(zip(part, np.diff(at, append=len(ids)).tolist(), strict=True))
    rest = [u for u in units if not _SIMPLE(u)]
    out.update((u, len(ids) - 2) for u, ids in zip(rest, model.encode(["\n" + u for u in rest], num_threads=1), strict=True))
    return [out[u] for u in units]


def _gathered(texts: DataFrame) -> DataFrame:
    """unit and n of every distinct pre-token of a frame's only column; tasks gather before the shuffle."""

    def batch(found: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["unit", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for b in slices(batches, BATCH):
            for t in b.column(0).to_pylist():
                found.update(pre_tokens(t) if t else ())
            if len(found) > GATHERED:
                yield batch(found)
                found.clear()
        yield batch(found)

    return texts.mapInArrow(run, "unit string, n bigint").groupBy("unit").agg(F.sum("n").alias("n"))


def _counted(units: DataFrame, path: str) -> DataFrame:
    """unit, n and pieces: each distinct pre-token is encoded here, and nowhere else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 20_000):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_count(path, b.column(0).to_pylist()), pa.int64())], names=["unit", "n", "pieces"])

    return units.mapInArrow(run, "unit string, n bigint, pieces bigint")


def _frequent(counted: DataFrame) -> DataFrame:
    """The units above the smallest power-of-two frequency that ``FREQUENT`` of them at most reach; how many have which
    magnitude is all that the driver learns for that."""
    sizes = {r["m"]: r["count"] for r in counted.groupBy(F.floor(F.log2("n")).cast("int").alias("m")).count().collect()}  # 64 rows at most
    least, total = 64, 0
    while least and total + sizes.get(least - 1, 0) <= FREQUENT:
        least -= 1
        total += sizes.get(least, 0)
    return counted.filter(F.floor(F.log2("n")).cast("int") >= least)


class Frequent:
    """Counts of the most frequent pre-tokens, as a worker looks them up."""

    def __init__(self, units: list[str], pieces: np.ndarray):
        self.units, self.pieces = units, pieces

    @cached_property
    def known(self) -> dict[str, int]:
        return dict(zip(self.units, self.pieces.tolist(), strict=True))

    def __getstate__(self) -> dict:
        return {"units": self.units, "pieces": self.pieces}


def _whole(plain: DataFrame, path: str, at: int) -> DataFrame:
    """The way for models whose pieces may span pre-tokens: each text is encoded whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, BATCH):
            n = [len(x) for x in _model(path).encode([t or "" for t in b.column(at).to_pylist()], num_threads=1)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64())], names=[*b.schema.names, "total"])

    return plain.mapInArrow(run, StructType([*plain.schema.fields, StructField("total", LongType())]))


def count_tokens(docs: DataFrame, model_path: str, text_col: str = "text", out_col: str = "n_tokens", keep: list[str] | None = None) -> DataFrame:
    """Adds ``out_col``: tokens of each whole text, as the library's ``encode`` gives them without added tokens.

    Null and empty texts have 0. Rows are neither dropped nor merged, so repeated ids and rows stay as they are; the
    columns ``keep`` (all, where it is not given) pass through, and a column already named ``out_col`` is replaced.

    Distinct pre-tokens of all texts are gathered and counted once each. Workers have the counts of the ``FREQUENT`` most
    frequent; a second pass sums these by document and writes, beside the kept columns, the few other pre-tokens with
    their frequencies, which meet their counts by a join."""
    docs = docs.drop(out_col)
    keep = [n for n in (docs.columns if keep is None else keep) if n != out_col]
    at, columns = docs.columns.index(text_col), [docs.columns.index(n) for n in keep]
    plain, names = plainly_named(docs), [f"c{i}" for i in columns]
    cut, lines = _separable(model_path)
    if not (cut and lines):
        return _whole(plain, model_path, at).select(*names, "total").toDF(*keep, out_col)
    counted = materialize(_counted(_gathered(plain.select(f"c{at}")), model_path))
    top = _frequent(counted).select("unit", "pieces").toPandas()  # FREQUENT short rows
    shared = docs.sparkSession.sparkContext.broadcast(Frequent(top["unit"].tolist(), top["pieces"].to_numpy()))
    cell = pa.list_(pa.struct([("unit", pa.string()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.known
        get = known.get
        for b in slices(batches, BATCH):
            sums, others = [], []
            for t in b.column(at).to_pylist():
                found = Counter(pre_tokens(t)) if t else {}
                pieces = list(map(get, found))
                if None in pieces:
                    others.append([{"unit": u, "n": n} for u, n in found.items() if u not in known])
                    pieces = [p or 0 for p in pieces]
                else:
                    others.append(None)
                sums.append(sum(map(mul, pieces, found.values())))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in columns), pa.array(sums, pa.int64()), pa.array(others, cell)], names=[*names, "total", "rare"])

    summed = plain.mapInArrow(run, StructType([*(plain.schema[n] for n in names), StructField("total", LongType()), StructField("rare", _RARE)]))
    if counted.count() == len(top):
        return summed.drop("rare").toDF(*keep, out_col)
    written = materialize(summed.withColumn("row", F.monotonically_increasing_id()))
    units = written.select("row", F.explode("rare").alias("x")).select("row", "x.unit", "x.n")
    more = units.join(counted.select("unit", "pieces"), "unit").groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("more"))
    both = written.join(more, "row", "left")
    return both.select(*names, F.col("total") + F.coalesce("more", F.lit(0))).toDF(*keep, out_col)


_RARE = ArrayType(StructType([StructField("unit", StringType()), StructField("n", LongType())]))


def document_tokens(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document; the text goes to the workers, not on to the result."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = count_tokens(texts, model_path, "text", keep=["doc_id", "n_bytes"])
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
