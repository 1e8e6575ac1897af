"""Storage of the operators: intermediate tables, free column names, file systems.

Intermediate tables are those of :mod:`glossaria.scratch`, below
``spark.checkpoint.dir``.
"""

from __future__ import annotations

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from glossaria.scratch import clear, discard, materialise, remove, scratch_path, shared_dir

__all__ = ["clear", "discard", "free_name", "materialise", "open_fs", "prepare", "remove", "scratch_path", "shared_dir"]


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the rows of an Arrow batch: texts can be long, and a worker holds a whole batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that starts with ``stem`` and that no column of ``df`` starts with, whatever the case."""
    while any(c.lower().startswith(stem.lower()) for c in df.columns):
        stem = f"_{stem}"
    return stem


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; a bare path is local."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    return pafs.FileSystem.from_uri(uri)
