"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfseek.llm import (bpe, cotraining, decontaminate, mixing, near_dedup, pii, quality_rules, repair, secrets,
                           spelling, suffix_dedup, url_filter, warc)

#: Vocabulary of the byte-level BPE query; its file lies beside the public tokenizers.
VOCABULARY = "byte_bpe_50k.json"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(_read(spark, sf_dir, "documents"))


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_read(spark, sf_dir, "documents"))


def op3_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(_read(spark, sf_dir, "pages"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(_read(spark, sf_dir, "documents"))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.report(_read(spark, sf_dir, "pages"))


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(_read(spark, sf_dir, "documents"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.report(_read(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op10_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.report(_read(spark, sf_dir, "conversations"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.report(_read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.report(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_mix, op2_surrogates, op3_warc_index, op4_quality_rules, op5_secrets, op6_url_rules, op7_repeated_passages,
        op8_near_duplicates, op9_decontaminate, op10_cotraining, op11_conversations, op12_bpe, op13_spelling)}
