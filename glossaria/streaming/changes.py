"""A glossary as a change feed, and state that expires."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaria.operators import sync
from glossaria.scratch import materialise


def change_feed(spark: SparkSession, path: str, snapshot: str, checkpoint: str, handle: Callable[[DataFrame, int], None], schema: str = "entry_id string, hash string, ts timestamp"):
    """A query over revisions of entries as they arrive below ``path`` (Parquet: entry_id, hash or null if it went, ts).

    A batch is compared with the saved snapshot, ``handle`` gets its changes
    (entry_id, change, old_hash, new_hash) and the snapshot follows. The latest
    revision of an entry in a batch counts. A batch that failed before its
    snapshot was saved hands its changes on again.
    """

    def step(batch: DataFrame, n: int) -> None:
        latest = materialise(batch.groupBy("entry_id").agg(F.max_by("hash", "ts").alias("hash")), "feed-latest")
        before = materialise(sync.load_snapshot(spark, snapshot), "feed-before")
        touched = before.join(latest.select("entry_id"), "entry_id", "left_semi")
        changes = materialise(sync.diff(touched, latest.filter("hash is not null")).filter("change <> 'unchanged'"), "feed-changes")
        handle(changes, n)
        after = before.join(latest.select("entry_id"), "entry_id", "left_anti").unionByName(latest.filter("hash is not null"))
        sync.save_snapshot(after, snapshot)

    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_within(events: DataFrame, key: str, at: str, ttl: str) -> DataFrame:
    """Of a stream, rows whose ``key`` wasn't seen within ``ttl`` before; a key's state expires with the watermark."""
    return events.withWatermark(at, ttl).dropDuplicatesWithinWatermark([key])
