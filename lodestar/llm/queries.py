"""One query per operator over its whole table, at production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import fingerprint, html, langid, lm, minhash, mixing, pieces, tokens, vectors, warc


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tokens.TokenConfig(public_tokenizers.path("byte_bpe_50k.json"))
    return tokens.token_table(spark, _documents(spark, sf_dir), c)


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.minhash_components(spark, _documents(spark, sf_dir), minhash.MinHashConfig(percent=85))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(spark, _documents(spark, sf_dir))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(spark, _documents(spark, sf_dir))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(spark, _documents(spark, sf_dir))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pieces.encode_documents(_documents(spark, sf_dir), pieces.PieceConfig(public_tokenizers.path("piece_bpe_32k.model")))
    return rows.select("doc_id", "n_chars", "n_pieces", F.crc32("pieces").alias("pieces_crc32"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.vector_links(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = warc.archived_pages(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    got = langid.identify(spark, rows, docs.where(~held_out).select("lang", "text"))
    return got.select("doc_id", "held_out", F.col("_lang_pred").alias("lang_pred"), F.col("_score").alias("score"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_token_files, op2_minhash_dedup, op3_fingerprints, op4_source_mix, op5_lm_scores, op6_pieces, op7_vector_dedup, op8_warc, op9_language, op10_main_text)
    return {f.__name__: f for f in found}


_OP2_SQL = r"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n_shingles FROM g),
x AS (SELECT doc_id, md5(unnest(sh)) AS s FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM x a JOIN x b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * n_both >= 85 * (na.n_shingles + nb.n_shingles - n_both)),
r(node, reach) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach)
SELECT n.doc_id, n.n_shingles, c.component_id, n.doc_id = c.component_id AS kept
FROM n JOIN (SELECT node, min(reach) AS component_id FROM r GROUP BY 1) c ON c.node = n.doc_id
"""

_OP7_SQL = """
WITH RECURSIVE
v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings),
u AS (SELECT vec_id, x, sqrt(list_sum(list_transform(x, lambda y: y * y))) AS norm FROM v),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.x, b.x) >= 0.9 * a.norm * b.norm),
r(node, reach) AS (SELECT vec_id, vec_id FROM u UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach)
SELECT u.vec_id, coalesce(l.n, 0) AS n_links, c.component_id, u.vec_id = c.component_id AS kept
FROM u LEFT JOIN (SELECT a, count(*) AS n FROM e GROUP BY 1) l ON l.a = u.vec_id
JOIN (SELECT node, min(reach) AS component_id FROM r GROUP BY 1) c ON c.node = u.vec_id
"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express a query; the others are tested against brute force in tests/llm."""
    return {"op2_minhash_dedup": _OP2_SQL, "op7_vector_dedup": _OP7_SQL}
