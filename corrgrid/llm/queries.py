"""Queries of the corpus operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corrgrid.llm.bpe import encode_digests
from corrgrid.llm.centroids import clusters, clusters_sql
from corrgrid.llm.chat import link_tools
from corrgrid.llm.common import table
from corrgrid.llm.exact_dedup import exact_dedup
from corrgrid.llm.mixing import entropy_mix
from corrgrid.llm.packing import pack_digests
from corrgrid.llm.pii import find_pii
from corrgrid.llm.secrets import secrets
from corrgrid.llm.simhash import near_dedup
from corrgrid.llm.substring_dedup import substring_dedup
from corrgrid.llm.tiered import SEARCH_SQL, ranked_search
from corrgrid.llm.topk import top_k
from corrgrid.llm.toxicity import toxicity


def op1_chat_tool_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_tools(table(spark, sf_dir, "conversations")).drop("errors")


def op2_topk_norm_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op3_substring_countmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op4_secrets_multipart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents")).drop("found")


def op5_pii_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op7_bpe_speculate_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"))


def op8_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy_mix(table(spark, sf_dir, "documents"))


def op9_simhash_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


def op10_toxicity_noisy_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_search_tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_clusters_drake(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "embeddings"))


def op13_packing_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_digests(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_chat_tool_linking, op2_topk_norm_sorted, op3_substring_countmin, op4_secrets_multipart, op5_pii_information, op6_exact_dedup, op7_bpe_speculate_verify, op8_entropy_mixing, op9_simhash_pigeonhole, op10_toxicity_noisy_channel, op11_search_tiered, op12_clusters_drake, op13_packing_best_fit)}

ORACLES = {
    # The table holds no tool calls; their linking is tested on fixtures.
    "op1_chat_tool_linking": """
        SELECT conv_id, turn, role, turn AS eff_turn, 0 AS level, 0 AS n_calls, 0 AS n_linked, 0 AS n_orphans, 0 AS n_invalid,
               '{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"role":' || coalesce(to_json(role)::VARCHAR, 'null') || '}' AS json
        FROM conversations""",
    "op2_topk_norm_sorted": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
                   FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
             r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op6_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM n""",
    "op11_search_tiered": SEARCH_SQL,
    "op12_clusters_drake": clusters_sql(),
}
