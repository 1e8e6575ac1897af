"""Load a glossary and build both of its indexes, once.

``load`` takes source rows through mapping, admission, dropping of rows that
say nothing, ids and validation, and reports what went; ``build`` makes the
postings and vectors that matching reads, which can be saved and read again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaria.functions import encoders, identifiers
from glossaria.functions.types import coerce_glossary
from glossaria.operators import ingest, lexical
from glossaria.plans.hooks import Hooks
from glossaria.scratch import materialise

Encoder = Callable[[DataFrame, str], DataFrame]


def entry_texts(entries: DataFrame) -> DataFrame:
    """doc_id, text."""
    return entries.select(F.col("id").alias("doc_id"), identifiers.searchable_text(F.col("business_name"), F.col("logical_name"), F.col("definition"), F.array().cast("array<string>")).alias("text"))


@dataclass
class GlossaryIndex:
    """``entries`` as loaded, their postings, and ``vectors`` (entry_id, vector)."""

    entries: DataFrame
    postings: lexical.Index
    vectors: DataFrame

    def save(self, path: str) -> None:
        self.entries.write.mode("overwrite").parquet(f"{path}/entries")
        self.postings.save(f"{path}/bm25")
        self.vectors.write.mode("overwrite").parquet(f"{path}/vectors")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> GlossaryIndex:
        return cls(spark.read.parquet(f"{path}/entries"), lexical.Index.load(spark, f"{path}/bm25"), spark.read.parquet(f"{path}/vectors"))


def load(rows: DataFrame, mapping: dict[str, str] | None = None, admit: dict[str, list[str]] | None = None, hooks: Hooks | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entries, refused rows with ``reason``, and the load report, from source rows with any headers.

    Rows are admitted by the values of source columns; ``ordinal`` numbers
    them in the order of the source's partitions.
    """
    hooks = hooks or Hooks()
    rows = hooks.run("load", rows)
    rows = hooks.run("admit", ingest.admit_rows(rows, admit or {}))
    mapped = hooks.run("map", ingest.map_frame(rows, mapping))
    # a monotone id is not stable over a second run, so it is written before anything reads it twice
    mapped = materialise(mapped.withColumn("ordinal", F.monotonically_increasing_id()), "glossary-rows")
    report = ingest.load_report(mapped)
    said = mapped.filter("business_name <> '' or definition <> ''").withColumn("data_type", coerce_glossary(F.col("data_type")))
    named = ingest.entry_ids(said).drop("id").withColumnRenamed("entry_id", "id")
    good, refused = ingest.validate(named)
    return hooks.run("entries", good), refused, report


def build(entries: DataFrame, encoder: Encoder = encoders.hashed_vectors, hooks: Hooks | None = None) -> GlossaryIndex:
    """Both indexes of ``entries`` (id, business_name, logical_name, definition, ...)."""
    texts = entry_texts(entries)
    if hooks:
        texts = hooks.run("index", texts)
    found = lexical.build_index(texts)
    postings = lexical.Index(materialise(found.postings, "glossary-postings"), found.stats)
    vectors = materialise(encoder(texts, "doc_id").select(F.col("doc_id").alias("entry_id"), "vector"), "glossary-vectors")
    return GlossaryIndex(entries, postings, vectors)
