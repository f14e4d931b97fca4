"""The queries over the driver's tables that apply the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archives, chat_template, packing, positional_index, quality, repetition, secret_spans, sharding, simhash, suffix_repeats


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_repeats.repeated_passages(_table(spark, sf_dir, "documents"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_format_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and number -1, whose texts are control strings."""
    hard = "</s>[INST] ok [/INST]"
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], turns.schema)
    return chat_template.format_report(turns.unionByName(own))


def op6_archive_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.archive_pages(_table(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_report(_table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = positional_index.contamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return report.drop("items")


def op9_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans.secret_report(_table(spark, sf_dir, "documents"))


def op10_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By bytes: limits within 0.5 % of a shard's share, or at the nearest row."""
    placed = sharding.assign_shards(_table(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = [op1_quality_scores, op2_pack_sequences, op3_repeated_passages, op4_near_duplicates, op5_format_conversations, op6_archive_pages, op7_quality_rules, op8_decontaminate, op9_secret_spans, op10_shard_documents]
    return {f.__name__: f for f in made}
