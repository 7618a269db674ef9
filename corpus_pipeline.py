"""A corpus pipeline: each stage takes what the one before has kept, from the documents table to packed sequences."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from featurekit.llm import decontaminate, near_dedup, packing, quality, toxicity
from featurekit.llm.common import collected, discard, materialize, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose quality score reaches the threshold.

    Each row is judged by its own text, whatever its id: null and repeated ids too, rows of one id each for itself. Null
    and empty texts have the score of a text without words. Columns stay as they are, clashing names among them; an
    empty table stays empty."""
    return quality.passing(docs, table(spark, sf_dir, "labels"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score stays below the threshold; odd rows as in ``quality_stage``. Null and empty texts have no
    neighbour and are rejected only if most examples without one are toxic."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that of the smallest id. A row is known by its id and text, so that rows
    of one id and different texts are judged each for itself; of rows that repeat both one stays. Rows without an id go
    before one that has an id does; alone in their group they stay. Empty and null texts are in no group."""
    return near_dedup.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that overlap no benchmark item, each judged by its own text, whatever its id. Empty and null texts, and null
    items, overlap nothing."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed sequences, with a checksum in place of their ids. Every row is packed for itself, repeated ones too; null and
    empty texts have the end token only."""
    return packing.packed_digest(packing.pack(docs, str(public_tokenizers.path("word_bpe_49k.json"))))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: A classifier fitted on a sample, nearest neighbours by cosine and a tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again by the next. Once a
    stage is written, its own intermediate tables and what the stage before it wrote are deleted."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with collected() as written:
            kept = materialize(stage(spark, docs, sf_dir))
        discard(docs, *(x for x in written if x is not kept))
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
