"""Intermediate tables in storage that driver and executors share.

Tables written here cut lineage, so a lost executor costs at most the tasks of
the stage that was running. They go below ``spark.checkpoint.dir``; where that
is unset a local master (as in tests) gets a temporary folder and a cluster an
error. A table stays until :func:`discard` or, with all others of the process,
until :func:`clear`.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one if it is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="glossaria-"))
    return _LOCAL[0]


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A path below the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/glossaria/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialise` that nothing reads any more."""
    for table in tables:
        path = getattr(table, "_scratch_path", None)
        if path in _WRITTEN:
            _WRITTEN.remove(path)
            remove(table.sparkSession, path)


def is_there(table: DataFrame) -> bool:
    """Whether a table of :func:`materialise` is still kept."""
    return getattr(table, "_scratch_path", None) in _WRITTEN


def clear(spark: SparkSession) -> None:
    """Delete all tables that this process wrote; results that read them must have been written or collected."""
    while _WRITTEN:
        remove(spark, _WRITTEN.pop())
