"""The corpus queries, one per operator, and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import byte_bpe, chat, embedding_dedup, exact_dedup, line_dedup, packing, sharding, simhash, substring_dedup, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", substring_dedup.words_sha256("text").alias("kept_sha256"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one more, -1, whose texts hold control strings."""
    given = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return chat.read_back(*chat.prefix_tree(given.unionByName(more)))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), 40)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def queries():
    return {"op1_simhash_near_dedup": op1_simhash_near_dedup, "op2_substring_dedup": op2_substring_dedup, "op3_line_dedup": op3_line_dedup, "op4_embedding_near_dedup": op4_embedding_near_dedup, "op5_toxicity": op5_toxicity, "op6_chat_prefix_tree": op6_chat_prefix_tree, "op7_best_fit_packing": op7_best_fit_packing, "op8_byte_bpe": op8_byte_bpe, "op9_sharding": op9_sharding, "op10_exact_dedup": op10_exact_dedup, "pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": line_dedup.SQL, "op6_chat_prefix_tree": chat.SQL, "op10_exact_dedup": exact_dedup.SQL}
