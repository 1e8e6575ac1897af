"""Results as JSON and CSV, and the append-only feedback trail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGNALS = ("s1", "s2", "s3", "s4", "s5")


def result_records(matches: DataFrame, weights: tuple[float, ...], top_k: int = 5, threshold: float = 0.0, tolerance: float = 1e-5) -> DataFrame:
    """One JSON text per match with its signals and weights; a match whose confidence they don't give is refused."""
    rows = matches.filter((F.col("rank") <= top_k) & (F.col("confidence") >= threshold))
    again = F.least(F.greatest(sum(w * F.col(s) for w, s in zip(weights, SIGNALS)), F.lit(0.0)), F.lit(1.0))
    checked = F.when(F.abs(again - F.col("confidence")) <= tolerance, F.col("confidence")).otherwise(F.raise_error(F.concat(F.lit("the signals of "), F.col("field_key"), F.lit(" don't give its confidence"))).cast("double"))
    record = F.struct(checked.alias("confidence"), "decision", "entry_id", "field_key", "rank", F.struct(*SIGNALS).alias("scores"), F.struct(*[F.lit(w).alias(s) for s, w in zip(SIGNALS, weights)]).alias("weights"))
    return rows.select(F.to_json(record).alias("value"))


def write_json(matches: DataFrame, path: str, weights: tuple[float, ...], **options) -> None:
    result_records(matches, weights, **options).write.mode("overwrite").text(path)


def write_csv(matches: DataFrame, path: str, top_k: int = 5, threshold: float = 0.0) -> None:
    matches.filter((F.col("rank") <= top_k) & (F.col("confidence") >= threshold)).write.mode("overwrite").option("header", True).csv(path)


def console_lines(matches: DataFrame, top_k: int = 1, threshold: float = 0.0) -> DataFrame:
    """field_key, rank, line: a line of fixed columns for each match, as a terminal shows it."""
    rows = matches.filter((F.col("rank") <= top_k) & (F.col("confidence") >= threshold))
    cut = lambda c, n: F.rpad(F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("~"))).otherwise(F.col(c)), n, " ")
    line = F.concat(cut("field_key", 32), F.lit("  "), cut("entry_id", 16), F.lit("  "), F.format_string("%3d  %.6f  ", "rank", "confidence"), F.col("decision"))
    return rows.select("field_key", "rank", line.alias("line"))


def print_matches(matches: DataFrame, top_k: int = 1, threshold: float = 0.0, most: int = 1000) -> None:
    """Print the first ``most`` lines."""
    for r in console_lines(matches, top_k, threshold).orderBy("field_key", "rank").limit(most).collect():
        print(r["line"])


def append_feedback(events: DataFrame, path: str) -> None:
    """Add reviewer events as JSON lines; files are never rewritten."""
    events.write.mode("append").json(path)


TRAIL = "ts string, reviewer string, field string, chosenGovernanceId string, suggestedGovernanceId string, wasCorrect boolean, verdict string"


def read_trail(spark, path: str) -> DataFrame:
    """Reviewer events; a line that isn't valid JSON is an error.

    Without a verdict, a correct suggestion is APPROVED and anything else
    UNSPECIFIED; a REJECTED event has no chosen id.
    """
    rows = spark.read.schema(TRAIL).option("mode", "FAILFAST").json(path)
    return events_of(rows)


def events_of(rows: DataFrame) -> DataFrame:
    verdict = F.coalesce("verdict", F.when(F.col("wasCorrect"), "APPROVED").otherwise("UNSPECIFIED"))
    return rows.withColumn("verdict", verdict).select(F.col("field").alias("field_key"), F.when(F.col("verdict") != "REJECTED", F.col("chosenGovernanceId")).alias("entry_id"), "verdict", "ts", "reviewer")
