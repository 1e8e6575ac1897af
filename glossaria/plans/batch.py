"""Matching many schema documents, each with its own success or failure."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaria.plans.config import MatchConfig
from glossaria.plans.match import match
from glossaria.scratch import materialise
from glossaria.sources import schemas


def match_documents(docs: DataFrame, entries: DataFrame, tree: DataFrame, cfg: MatchConfig | None = None, kind: str | None = None, fail_fast: bool = False, max_errors: int | None = None, progress: Callable[[int, int], None] | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """Matches of all fields of ``docs`` (source, content), and a row for each document: source, fields, matched, error.

    Documents are parsed in parallel and all their fields are matched as one
    plan. ``fail_fast`` refuses the batch at its first bad document,
    ``max_errors`` beyond so many; ``progress`` gets the good and all documents.
    """
    rows = materialise(schemas.parse_documents(docs, kind), "batch-fields")
    counts = rows.select("source", "error").distinct().agg(F.count_if(F.col("error").isNull()).alias("good"), F.count_if(F.col("error").isNotNull()).alias("bad")).first()
    if counts["bad"] and (fail_fast or max_errors is not None and counts["bad"] > max_errors):
        first = rows.filter("error is not null").orderBy("source").first()
        raise ValueError(f"{counts['bad']} documents failed; {first['source']}: {first['error']}")
    if progress:
        progress(counts["good"], counts["good"] + counts["bad"])
    fields = rows.filter("error is null").withColumn("field_key", F.concat_ws("#", "source", F.col("ordinal").cast("string"))).withColumn("declared_domain", F.lit(""))
    found = materialise(match(fields, entries, tree, cfg, **options), "batch-matches")
    hits = found.filter("rank = 1").join(fields.select("field_key", F.col("source").alias("_s")), "field_key").groupBy("_s").agg(F.count(F.lit(1)).alias("matched"))
    status = rows.groupBy("source").agg(F.count("name").alias("fields"), F.max("error").alias("error")).join(hits, F.col("source") == F.col("_s"), "left")
    return found, status.select("source", "fields", F.coalesce("matched", F.lit(0)).alias("matched"), "error")
