"""Registered queries of the operators, with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from lakewright.llm import (conversations, decontaminate, exact_dedup, lexical, license_scan, nearest, ngram_join, packing, pii,
                            quality, toxicity, url_filter, wavelet)
from lakewright.llm.common import read

TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "")


def tokenizer_path(name: str) -> str:
    if TOKENIZERS:
        return os.path.join(TOKENIZERS, name)
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit_quality(docs, read(spark, sf_dir, "labels")))


def op3_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, read(spark, sf_dir, "labels")))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(read(spark, sf_dir, "documents"), words=4, threshold=85)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents")).drop("row")


def op5_link_graph_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(read(spark, sf_dir, "pages"))


def op6_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(read(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), True, 0)


def op9_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from uuid import uuid4

    from lakewright.session import require_checkpoint_dir
    path = f"{require_checkpoint_dir(spark).rstrip('/')}/llm-shards-{uuid4().hex}"
    wavelet.write_token_shards(read(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"), False, 2)
    return wavelet.read_token_shards(spark, path)


def op10_license_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(read(spark, sf_dir, "documents"))


def op11_block_table_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.damage_and_repair(read(spark, sf_dir, "conversations"))


def op12_bag_dedup_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=10)


def op13_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(read(spark, sf_dir, "embeddings"), every=20, k=20)


QUERIES = {f.__name__: f for f in (op1_bradley_terry_quality, op2_ngram_jaccard_join, op3_noisy_channel_toxicity, op4_exact_dedup,
                                  op5_link_graph_url_filter, op6_simhash_decontamination, op7_bootstrapped_pii, op8_packing, op9_wavelet_shards, op10_license_set_join,
                                  op11_block_table_repair, op12_bag_dedup_search, op13_collision_counting)}

# The other queries are models, iterations, joins over sets or files: they are tested
# against brute force, round trips and held-out labels.
ORACLE_SQL: dict[str, str] = {
    "op4_exact_dedup": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
             n AS (SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars,
                          sha256(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS s FROM d)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
               row_number() OVER w = 1 AS kept, s AS text_sha256, n_chars
        FROM n WINDOW w AS (PARTITION BY s ORDER BY n_chars DESC, doc_id)""",
    "op12_bag_dedup_search": r"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
             total AS (SELECT CAST(count(*) FILTER (len(w) > 0) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS l FROM d),
             b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
             tf AS (SELECT r, t, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM b) GROUP BY r, t),
             wt AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, total GROUP BY t),
             m AS (SELECT r, doc_id, 10 + (90 * CAST(len(w) AS BIGINT) * n_docs) // l AS m FROM d, total),
             s AS (SELECT b.item_id, m.doc_id, CAST(sum(wt.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * m.m))) AS BIGINT) AS score
                   FROM b JOIN tf USING (t) JOIN wt USING (t) JOIN m USING (r) GROUP BY b.item_id, m.doc_id, r)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
        FROM s WHERE score > 0 QUALIFY rank <= 10""",
}
