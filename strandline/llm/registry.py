"""The queries of this package's operators, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import bpe, chunk_dedup, decontamination, host_reputation, jaccard_join, oracles, pseudonyms, quality_rules, shared, sharding, suffix_dedup, token_shards

#: Key of the registered pseudonym query. A real run takes its own secret.
PSEUDONYM_KEY = "strandline-demonstration-key"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymise_counted(docs, PSEUDONYM_KEY)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.report(docs, read(spark, sf_dir, "benchmark"), ["doc_id"])


def op3_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.deduplicated(read(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(read(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = quality_rules.measures(read(spark, sf_dir, "documents"), ["doc_id", "lang", "source"])
    own = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality_rules.judge(counts).select(*own)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digest_documents(read(spark, sf_dir, "documents"), ["doc_id"], path, public_tokenizers.PATTERN)


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    shards = token_shards.write_shards(read(spark, sf_dir, "documents"), shared.folder(spark, "token-shards"), path, end=2)
    return token_shards.read_shards(shards)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.report(sharding.sharded(read(spark, sf_dir, "documents").select("doc_id", "text"), 16))


def op9_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages take the label of the document of their number."""
    labels = read(spark, sf_dir, "labels")
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    return host_reputation.judge(read(spark, sf_dir, "pages"), labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.grouped(read(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pseudonyms, op2_decontamination, op3_chunk_dedup, op4_suffix_dedup, op5_quality_rules, op6_bpe,
        op7_token_shards, op8_sharding, op9_host_reputation, op10_jaccard_join,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": oracles.DECONTAMINATION,
    "op5_quality_rules": oracles.QUALITY,
    "op9_host_reputation": host_reputation.ORACLE_SQL,
    "op10_jaccard_join": oracles.JACCARD,
}
