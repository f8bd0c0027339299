"""The registered queries of this folder: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, fingerprints, mixing, ngram_scores, pii, sharding, simhash, token_counts, toxicity
from .common import small_batches, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_with_next(table(spark, sf_dir, "documents"))


def op2_bpe_prefix_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), keep_text=False))


def op3_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.sharded(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"))


def op5_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.learned(docs, labels.where(~toxicity.held_out()))
    found = toxicity.scored(docs.select("doc_id", "text"), model, keep_text=False)
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_budget_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op7_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))


def op8_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_scores.scored(table(spark, sf_dir, "documents"))
    per_word = F.round(F.col("log_score") / F.greatest("n_words", F.lit(1)), 6)
    return found.select("doc_id", "n_words", "n_seen", F.round("log_score", 4).alias("log_score"), per_word.alias("per_word"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", token_counts.n_bytes("text").alias("n_bytes"))
    counted = token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_text=False)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op10_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False))


def _bounded(query: Query) -> Query:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    return {f.__name__: _bounded(f) for f in (op1_multiset_hash, op2_bpe_prefix_dp, op3_label_propagation, op4_posting_lists, op5_compression_toxicity, op6_budget_mix, op7_simhash_golay, op8_stupid_backoff, op9_token_counts, op10_skip_chain_pii)}


def oracle_sql() -> dict[str, str]:
    return {"op8_stupid_backoff": ngram_scores.ORACLE}
