"""The corpus pipeline: language ID, near-duplicates, source mixing, piece encoding.

Every stage takes the columns of documents, under whatever further ones, and all but the last return just those.
Defined results: an empty table stays empty; null and blank texts, which have no language, go in the first stage;
rows that repeat doc_id and text are one document, rows of a doc_id with different texts are several; very long
texts are taken whole; ties are settled as the operators say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import langid, minhash, mixing, pieces
from lodestar.llm.common import Scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; those without a letter (or text) go."""
    got = langid.identify(spark, docs.select(*COLUMNS), docs.select("lang", "text"))
    return got.where(F.col("_lang_pred") != "und").select(*COLUMNS)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest doc_id (null last, then by text's hash).

    Documents are told apart by a hash of doc_id and text, so rows of one doc_id with different texts don't fall
    together; of rows that repeat both, the one with the least lang, source and n_chars stays.
    """
    rows = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("_row"))
    found = minhash.minhash_components(spark, rows.select(F.col("_row").alias("doc_id"), "text"))
    ids = rows.select("_row", "doc_id").distinct().join(found.select(F.col("doc_id").alias("_row"), "component_id").distinct(), "_row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "_row"))
    kept = ids.groupBy("component_id").agg(first.alias("x")).select("x._row")
    rows = rows.join(kept, "_row", "left_semi")
    return rows.groupBy("_row").agg(F.min(F.struct(*COLUMNS)).alias("x")).select("x.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(spark, docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, and whether they decode to its text."""
    c = pieces.PieceConfig(public_tokenizers.path("piece_bpe_32k.model"))
    got = pieces.encode_documents(docs, c)
    return got.select("doc_id", "n_chars", "n_pieces", "pieces", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", keep_identified), ("minhash_dedup", keep_distinct), ("source_mix", mix_sources), ("piece_encoding", encode)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again."""
    s = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = s.save(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            s.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
