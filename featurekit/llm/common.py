"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd 64-bit multipliers that tell positions of a window apart.
_MULTIPLIERS = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1) ** 3 | 1) % 2**64 for i in range(64)], dtype=np.uint64)


#: Where written frames lie, and lists of them that are being collected.
_WRITTEN: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_COLLECTED: list[list[DataFrame]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where that is unset, a folder of our own if executors are threads of
    this machine, as in tests; elsewhere they could not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="featurekit-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir() or own


def materialize(df: DataFrame) -> DataFrame:
    """Writes a frame to the shared folder and reads it back, so a lost executor costs no recomputation of what lies before."""
    path = f"{scratch_dir(df.sparkSession)}/featurekit-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    _WRITTEN[found] = path
    for frames in _COLLECTED:
        frames.append(found)
    return found


@contextmanager
def collected() -> Iterator[list[DataFrame]]:
    """All frames that ``materialize`` writes meanwhile."""
    frames: list[DataFrame] = []
    _COLLECTED.append(frames)
    try:
        yield frames
    finally:
        _COLLECTED.pop()


def discard(*frames: DataFrame) -> None:
    """Deletes what ``materialize`` wrote; nothing that is still to be read may depend on it. Other frames are left alone."""
    for df in frames:
        if path := _WRITTEN.pop(df, None):
            at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def slices(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches of ``size`` rows at most."""
    for b in batches:
        yield from (b.slice(i, size) for i in range(0, b.num_rows, size))


def rows_that(docs: DataFrame, text_col: str, make: Callable[[], Callable[[list[str | None]], list[bool]]], size: int, over: Callable[[], object] = lambda: None) -> DataFrame:
    """The rows, as they were, whose texts a function says yes to; each task makes the function for itself, and calls
    ``over`` when it has no more rows. Rows pass through the workers whole, so nothing is joined."""
    at = docs.columns.index(text_col)
    plain = plainly_named(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = make()
        for b in slices(batches, size):
            yield b.filter(pa.array(wanted(b.column(at).to_pylist()), pa.bool_()))
        over()

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def plainly_named(df: DataFrame) -> DataFrame:
    """The same columns, named c0, c1 and so on: what calls Python takes no names with dots."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that no column of ``df`` has, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = f"_{name}"
    return name


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 over an array of uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def window_hashes(h: np.ndarray, offsets: list[int]) -> np.ndarray:
    """A 64-bit hash of the items at ``offsets`` of every window of ``h`` that lies within it."""
    n = len(h) - offsets[-1]
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for o in offsets:
        total += h[o : o + n] * _MULTIPLIERS[o]
    return mix64(total)


def ascii_words(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased; bytes methods touch ASCII only, as the contracts ask."""
    return text.lower().split()


def held_remainder(column: str, modulus: int):
    """crc32 of an id's decimal text, modulo ``modulus``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus
