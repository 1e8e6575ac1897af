"""Streams of reviewer events and of schema files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from glossaria.sources.schemas import parse_documents
from glossaria.sources.sinks import TRAIL, events_of

STATE = "entry_id string, verdict string, seq string, revoked long"
OUTPUT = "field_key string, entry_id string, verdict string, standing boolean, revoked long"


def read_trail_stream(spark: SparkSession, path: str, files_a_batch: int = 100) -> DataFrame:
    """The feedback trail as a stream of events."""
    return events_of(spark.readStream.schema(TRAIL).option("maxFilesPerTrigger", files_a_batch).json(path))


def _fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    entry, verdict, seq, revoked = state.get if state.exists else (None, None, "", 0)
    rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
    for r in rows.itertuples():
        if r.ts < seq:
            continue
        if r.verdict == "REJECTED":
            revoked += entry is not None
            entry, verdict = None, None
        else:
            entry, verdict = r.entry_id, r.verdict
        seq = r.ts
    state.update((entry, verdict, seq, revoked))
    yield pd.DataFrame([(key[0], entry, verdict, entry is not None, revoked)], columns=["field_key", "entry_id", "verdict", "standing", "revoked"])


def standing_verdicts_stream(events: DataFrame) -> DataFrame:
    """Per field and batch its standing verdict after the events so far; a rejection removes it.

    State is one row for each field. Events of a field that come late (an
    older ``ts`` than the last folded) are passed over.
    """
    return events.groupBy("field_key").applyInPandasWithState(_fold, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def match_dropped_schemas(spark: SparkSession, path: str, checkpoint: str, handle: Callable[[DataFrame, int], None], files_a_batch: int = 50):
    """A query that parses schema files as they arrive and hands each batch's field rows to ``handle``."""
    files = spark.readStream.option("maxFilesPerTrigger", files_a_batch).option("wholetext", True).format("text").load(path)
    docs = files.select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("content"))
    return docs.writeStream.foreachBatch(lambda batch, n: handle(parse_documents(batch), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Events by type and window; works on tables and, with a watermark for late rows, on streams."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each user: events with at most ``gap`` between them."""
    s = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy("user_id", s.alias("s")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
