"""Packing (operator 10): power-of-two decomposition. Every piece is a sequence of its own, as long as a power of two."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct words, and pre-tokens, that a worker remembers before it starts over; bounds its memory, never the result.
REMEMBERED = 600_000
BATCH = 256


@cache
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Texts of which Python lower-cases, composes and classifies every character as the library does.
_PLAIN = re.compile("[\t-\r -~¡-¬®-įı-ſ]*").fullmatch


@cache
def _pre_tokens(path: str):
    """The file's own splitting pattern, if it is lower-cased text split by one pattern (else None)."""
    import json

    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    steps = [x["type"] for x in (j.get("normalizer") or {}).get("normalizers", [])]
    splits = (j.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if steps != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in splits] != ["Split", "ByteLevel"] or not splits[0]["invert"] or splits[0]["behavior"] != "Removed" or splits[1]["use_regex"] or splits[1]["add_prefix_space"]:
        return None
    return regex.compile(splits[0]["pattern"]["Regex"]).findall


@cache
def _known(path: str) -> tuple[dict[str, bytes], dict[str, bytes]]:
    """Ids of words and of pre-tokens that this worker has met so far; tasks share them."""
    return {}, {}


@cache
def _ends(path: str) -> np.ndarray:
    """By id: whether it ends a pre-token."""
    tok = _tokenizer(path)
    return np.array([(tok.id_to_token(i) or "").endswith("</w>") for i in range(tok.get_vocab_size())])


def _encode_pre_tokens(path: str, units: list[str]) -> Iterator[tuple[str, bytes]]:
    """Pre-tokens of plain texts, many to a text; each ends at the one id that ends a word."""
    tok, ends = _tokenizer(path), _ends(path)
    for i in range(0, len(units), 1000):
        part = units[i : i + 1000]
        ids = np.array(tok.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
        stops = np.flatnonzero(ends[ids]) + 1
        raw, begin = ids.tobytes(), 0
        for u, stop in zip(part, stops.tolist(), strict=True):
            yield u, raw[4 * begin : 4 * stop]
            begin = stop


def _words(text: str) -> list[str]:
    """What lies between ASCII blanks (str.split() would also cut at blanks that the library keeps)."""
    for blank in "\n\t\r\v\f":
        text = text.replace(blank, " ")
    return text.split(" ")


def _encode_words(path: str, words: list[str]) -> Iterator[tuple[str, bytes]]:
    tok, split, known = _tokenizer(path), _pre_tokens(path), _known(path)[1]
    special = [t.content for t in tok.get_added_tokens_decoder().values()]
    plain = {w: split(w.lower()) for w in words if _PLAIN(w) and not any(s in w for s in special)} if split else {}
    rest = [w for w in words if w not in plain]
    yield from ((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(rest, tok.encode_batch_fast(rest, add_special_tokens=False), strict=True))
    if len(known) > REMEMBERED:
        known.clear()
    known.update(_encode_pre_tokens(path, list({u for us in plain.values() for u in us if u not in known})))
    yield from ((w, b"".join(map(known.__getitem__, us))) for w, us in plain.items())


def encoder(path: str):
    """A function from texts to their ids as little-endian uint32 bytes. A word between ASCII blanks has the ids it has
    alone, and so has a pre-token of plain characters; each distinct one is encoded once."""
    known = _known(path)[0]

    def encode(texts: list[str | None]) -> list[bytes]:
        words = [_words(t) if t else [] for t in texts]
        if len(known) > REMEMBERED:
            known.clear()
        if new := list({w for ws in words for w in ws if w not in known}):
            known.update(_encode_words(path, new))
        return [b"".join(map(known.__getitem__, ws)) for ws in words]

    return encode


def lengths(n: int, limit: int) -> list[int]:
    """``n`` as full pieces of ``limit`` (a power of two) and then the powers of two of its remainder, large to small."""
    rest = n % limit
    return [limit] * (n // limit) + [1 << b for b in range(limit.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer_path: str, limit: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: the id, start, length, ids (little-endian uint32 bytes), doc_tokens, sequence_id, offset, bucket.

    A document's ids are those of its whole text and then ``end_id``; null and empty texts have that one id. Each piece
    is a sequence: offset 0, no padding, one document. Sequences of equal length form a bucket, numbered by the length's
    logarithm, from which a loader draws batches (``write_buckets``). Repeated rows and ids are packed each for itself. Other columns are not read. There is no shuffle;
    sequence_id comes from partition and position, the same again when a lost task reruns."""
    if limit & (limit - 1) or limit < 1:
        raise ValueError("limit must be a power of two")
    kind = docs.schema[id_col].dataType
    schema = f"doc {kind.simpleString()}, start bigint, length bigint, ids binary, doc_tokens bigint"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer_path), np.array([end_id], "<u4").tobytes()
        for big in batches:
            for b in (big.slice(i, BATCH) for i in range(0, big.num_rows, BATCH)):
                at, start, size, ids, total = [], [], [], [], []
                for k, raw in enumerate(encode(b.column(1).to_pylist())):
                    raw += end
                    n = len(raw) // 4
                    cuts = lengths(n, limit)
                    begins = [0, *accumulate(cuts)][:-1]
                    at += [k] * len(cuts)
                    start += begins
                    size += cuts
                    ids += [raw[4 * s : 4 * (s + c)] for s, c in zip(begins, cuts, strict=True)]
                    total += [n] * len(cuts)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(ids, pa.binary()), pa.array(total, pa.int64())], names=names)

    pieces = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    bucket = F.bit_count(F.col("length") - 1)
    return pieces.withColumnRenamed("doc", id_col).withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"), "bucket": bucket})


def write_buckets(pieces: DataFrame, path: str) -> None:
    """A folder for each bucket, so that a loader draws batches of sequences of one length without looking at others.
    Every task writes its own pieces; nothing is shuffled."""
    pieces.write.partitionBy("bucket").parquet(path)


def packed_digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")
