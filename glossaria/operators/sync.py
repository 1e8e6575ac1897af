"""Change detection between two readings of a glossary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """entry_id, change (added, updated, removed, unchanged), old_hash, new_hash for (entry_id, hash) rows."""
    rows = previous.select("entry_id", F.col("hash").alias("old_hash")).join(current.select("entry_id", F.col("hash").alias("new_hash")), "entry_id", "full_outer")
    change = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").when(F.col("old_hash") != F.col("new_hash"), "updated").otherwise("unchanged")
    return rows.select("entry_id", change.alias("change"), "old_hash", "new_hash")


def report(changes: DataFrame) -> DataFrame:
    """added, updated, removed, unchanged, to_embed, savings_pct, change_ratio: one row."""
    n = lambda kind: F.count_if(F.col("change") == kind)
    now = n("added") + n("updated") + n("unchanged")
    return changes.agg(
        n("added").alias("added"),
        n("updated").alias("updated"),
        n("removed").alias("removed"),
        n("unchanged").alias("unchanged"),
        (n("added") + n("updated")).alias("to_embed"),
        F.round(F.when(now > 0, 100.0 * n("unchanged") / now).otherwise(0.0), 6).alias("savings_pct"),
        F.round(F.when(F.count(F.lit(1)) > 0, (n("added") + n("updated") + n("removed")) / F.count(F.lit(1))).otherwise(0.0), 6).alias("change_ratio"),
    )


def embed_plan(changes: DataFrame, current: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``current`` to embed, and the vectors that are kept."""
    fresh = changes.filter(F.col("change").isin("added", "updated")).select("entry_id")
    kept = changes.filter(F.col("change") == "unchanged").select("entry_id")
    return current.join(fresh, "entry_id", "left_semi"), vectors.join(kept, "entry_id", "left_semi")


def sync(previous: DataFrame, current: DataFrame, vectors: DataFrame, encode) -> DataFrame:
    """Vectors of the current glossary: kept ones, and ``encode`` (DataFrame -> entry_id, vector) of the changed."""
    fresh, kept = embed_plan(diff(previous, current), current, vectors)
    return kept.unionByName(encode(fresh))


def save_snapshot(current: DataFrame, path: str) -> None:
    current.select("entry_id", "hash").write.mode("overwrite").parquet(path)


def load_snapshot(spark, path: str) -> DataFrame:
    """The saved hashes; without a snapshot none, so that everything counts as added."""
    try:
        return spark.read.schema("entry_id string, hash string").parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], "entry_id string, hash string")
