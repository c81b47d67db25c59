"""The corpus pipeline: from raw documents to the mix that is trained on.

Every stage takes and returns whole documents; what it returns is written to
the shared folder and read again as the next one's input.

Defined results. Documents without text or with too few words go in the first
stage; null ids stay, equal texts of them are one document. Of repeated rows one
stays. Empty tables give empty results; without labels of both classes the
counts of the first stage decide alone. Other columns, whatever their names,
come through unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfseek.llm import decontaminate, mixing, near_dedup, quality_rules, secrets
from shelfseek.sources.tables import stored

#: Words of a shingle in the near-duplicate stage.
SHINGLE_WORDS = 5


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality rules reject."""
    return quality_rules.keep_good(docs, _read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates."""
    return near_dedup.unique_documents(docs, SHINGLE_WORDS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold benchmark passages."""
    return decontaminate.decontaminate(docs, _read(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask secrets in the texts."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources meet their weights; adds ``mix_copy``."""
    return mixing.mix(docs)


STAGES = [("quality rules", keep_good), ("near-duplicates", drop_near_duplicates),
          ("benchmark decontamination", drop_contaminated), ("secret scan", mask_secrets),
          ("mixing", mix_sources)]

#: The classifier and the rounding are beyond SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = _read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
