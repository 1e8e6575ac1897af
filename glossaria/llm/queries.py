"""Queries of the subpackage over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaria.llm import decontaminate, langid, near_dedup, packing, perplexity, quality_rules, secret_scan, token_codes, url_filter, warc
from glossaria.llm.storage import prepare

#: Folder of the vocabulary files; None: that of the installed package.
TOKENIZER_DIR: str | None = None


def vocabulary(name: str) -> str:
    if TOKENIZER_DIR:
        return f"{TOKENIZER_DIR}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


#: Rules of op9: host, start of the path, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "pages"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return secret_scan.scan(docs, secret_scan.fitted(docs))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(spark, _table(spark, sf_dir, "pages"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), k=4, percent=80)


def op7_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_codes.round_trip(spark, _table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 2)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).alias("bad"))
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), labels, URL_RULES)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), 2, 1024)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_secret_scan": op2_secret_scan,
    "op3_warc": op3_warc,
    "op4_quality_rules": op4_quality_rules,
    "op5_perplexity": op5_perplexity,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_token_codes": op7_token_codes,
    "op8_decontamination": op8_decontamination,
    "op9_url_filter": op9_url_filter,
    "op10_best_fit_packing": op10_best_fit_packing,
}

#: SQL of the operators that SQL can express; the others are tested by brute force.
ORACLE: dict[str, str] = {"op3_warc": warc.ORACLE, "op8_decontamination": decontaminate.ORACLE}
