"""The registered queries of this package: each applies its operator to the whole table it is meant for."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourcast.llm import ann, divergence, jaccard, langid, licenses, linededup, mixing, neardup, packing, passages, quality, tokenfiles, whitening
from hourcast.llm.common import scratch, settle, tables_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        def settled(spark: SparkSession, sf_dir: str) -> DataFrame:
            return run(settle(spark), sf_dir)

        settled.__name__, settled.__doc__ = name, run.__doc__
        QUERIES[name] = settled
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


@query("op1_license_scan")
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices and identifier expressions of all documents."""
    return licenses.scan_licenses(tables_of(spark, sf_dir, "documents"))


@query("op4_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from those that are not held out."""
    docs = tables_of(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


@query("op7_token_files")
def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as a token file set and read back."""
    folder = scratch(spark, "token-files")
    tokenfiles.write_token_files(tables_of(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return tokenfiles.document_checks(spark, folder)


@query("op8_curriculum_mix", mixing.SQL)
def curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken from all documents, and their positions in training."""
    return mixing.mix_sources(tables_of(spark, sf_dir, "documents"))


@query("op5_window_packing")
def window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 4096 tokens."""
    return packing.pack_documents(tables_of(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op6_importance_resampling")
def importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weights of all documents towards those labelled good, and a sample of half of them."""
    return quality.resample(tables_of(spark, sf_dir, "documents"), tables_of(spark, sf_dir, "labels"))


@query("op2_line_dedup")
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines deleted from all documents, and what is left of them."""
    out = linededup.dedup_lines(tables_of(spark, sf_dir, "documents"))
    left = F.coalesce(F.col("text"), F.lit(""))
    return out.select("doc_id", F.col("n_lines").cast("long"), F.col("n_deleted").cast("long"), F.octet_length(left).cast("long").alias("n_bytes_left"), F.crc32(left.cast("binary")).alias("text_crc32"))


@query("op10_jaccard_join")
def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all documents that share at least 85 % of their 4-word shingles."""
    return jaccard.jaccard_groups(tables_of(spark, sf_dir, "documents")).drop("text_hash")


@query("op3_embedding_near_dedup")
def embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all embeddings of one label with a cosine of 0.93 or more."""
    return neardup.near_duplicates(tables_of(spark, sf_dir, "embeddings"))


@query("op9_nearest_neighbours")
def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest embeddings of every embedding whose id is divisible by 20."""
    return ann.nearest(tables_of(spark, sf_dir, "embeddings"))


@query("op11_embedding_whitening")
def embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings whitened on their 32 leading components."""
    return whitening.whiten(tables_of(spark, sf_dir, "embeddings"))


@query("op12_source_divergence", divergence.SQL)
def source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How every source of all documents differs from the others of its language, and in which terms from the language."""
    return divergence.audit_sources(tables_of(spark, sf_dir, "documents"))


@query("op13_substring_dedup", passages.SQL)
def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words removed from all documents because a document with a smaller id holds the same 50, and what is left."""
    out = passages.dedup_passages(tables_of(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
