"""The queries of the training-data operators: each applies one with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from featurekit.llm import (
    chat,
    decontaminate,
    fill_in_middle,
    license_scan,
    near_dedup,
    packing,
    phrases,
    quality,
    quality_rules,
    token_counts,
    topk_search,
    toxicity,
    url_filter,
)
from featurekit.llm.common import table


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page url by the fixed rules, and by listed hosts where none fits."""
    return url_filter.page_verdicts(table(spark, sf_dir, "pages"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every conversation with its recovered role and canonical form; roles given in the table are learnt from only."""
    turns = table(spark, sf_dir, "conversations")
    return chat.format_chats(turns, chat.learn(turns))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; learnt from labels that are not held out."""
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size, component and whether it is kept, of every document."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all codes for every row whose id is divisible by 20."""
    return topk_search.nearest_embeddings(table(spark, sf_dir, "embeddings"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether they exceed 4096."""
    return token_counts.document_tokens(table(spark, sf_dir, "documents"), str(public_tokenizers.path("piece_bpe_32k.model")))


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of phrases, labels and score of every document."""
    return license_scan.license_digest(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, with its nearest examples and words of evidence."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that overlap, with its best place."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document, with a checksum of its ids."""
    return packing.packed_digest(packing.pack(table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json"))))


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2,000 phrases whose words keep together most."""
    return phrases.top_phrases(table(spark, sf_dir, "documents"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of every document, its distances to its language's histograms, and whether it is kept."""
    return quality_rules.document_rules(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units, form and digests of every document's fill-in-the-middle form."""
    return fill_in_middle.document_digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filters,
        op2_chat_formatting,
        op3_quality,
        op4_near_dedup,
        op5_topk_search,
        op6_token_counts,
        op7_license_scans,
        op8_toxicity,
        op9_decontamination,
        op10_packing,
        op11_phrase_mining,
        op12_quality_rules,
        op13_fill_in_middle,
    )
}

#: Where SQL can give the same rows.
#: The nearest rows by brute force, over all pairs of a query and a row.
TOPK_SQL = """
WITH c AS (SELECT DISTINCT vec_id, embedding FROM embeddings),
s AS (SELECT vec_id, [x > 0 for x in embedding[1:64]] AS bits FROM c),
d AS (SELECT q.vec_id, s.vec_id AS neighbour, min(list_sum([CAST(z[1] <> z[2] AS INT) for z in list_zip(q.bits, s.bits)])) AS distance FROM s q JOIN s ON q.vec_id <> s.vec_id WHERE q.vec_id % 20 = 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour) AS rank FROM d)
SELECT vec_id, CAST(rank AS INT) AS rank, neighbour, CAST(distance AS INT) AS distance FROM r WHERE rank <= 10
"""

#: Links between all documents that share a shingle, on full sets, and what can be reached by them.
NEAR_SQL = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct([array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)]) END AS sh FROM w),
u AS (SELECT r, unnest(sh) AS x, len(sh) AS n FROM s),
l AS (SELECT a.r AS ra, b.r AS rb FROM u a JOIN u b ON a.x = b.x AND a.r <> b.r GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach(r, t) AS (SELECT r, r FROM s UNION SELECT reach.r, l.rb FROM reach JOIN l ON reach.t = l.ra),
c AS (SELECT reach.r, min(s.doc_id) AS component_id FROM reach JOIN s ON reach.t = s.r GROUP BY reach.r)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c USING (r)
"""

ORACLE: dict[str, str] = {
    "op1_url_filters": url_filter.SQL,
    "op4_near_dedup": NEAR_SQL,
    "op5_topk_search": TOPK_SQL,
    "op11_phrase_mining": phrases.SQL,
    "op12_quality_rules": quality_rules.SQL,
    "op13_fill_in_middle": fill_in_middle.SQL,
}
