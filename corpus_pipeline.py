"""A corpus pipeline of operators in ``glossaria.llm``.

Documents that fail the quality rules go, one of each group of near duplicates
stays, documents that contain a benchmark item go, secrets are masked, and
what is left is packed into sequences. Every stage but the last returns the
columns of its input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glossaria.llm import decontaminate, near_dedup, packing, quality_rules, secret_scan
from glossaria.llm.queries import vocabulary
from glossaria.llm.storage import materialise, prepare

SEQUENCE_TOKENS = 1024
END_ID = 2


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.quality_filter(docs, prepare(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return near_dedup.deduplicate(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return secret_scan.redact(docs, secret_scan.fitted(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), END_ID, SEQUENCE_TOKENS)


STAGES = [
    ("quality_rules", quality_stage),
    ("near_dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("secret_scan", secrets_stage),
    ("packing", packing_stage),
]

#: The stages' thresholds, forest and tokenizer can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
