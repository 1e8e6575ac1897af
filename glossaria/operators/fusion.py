"""Fusion of a dense and a sparse candidate list.

Both lists are DataFrames (query_id, doc_id, score); one full outer join feeds
every method, and all windows share one partitioning by query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossaria.functions.vectors import rrf

METHODS = ("rrf", "linear", "combsum", "combmnz", "max")


def ranked(rows: DataFrame, name: str) -> DataFrame:
    """query_id, doc_id, <name>_score, <name>_rank (from 1), <name>_norm (min-max, 0 for a constant list)."""
    by = Window.partitionBy("query_id")
    span = F.max("score").over(by) - F.min("score").over(by)
    return rows.select(
        "query_id",
        "doc_id",
        F.col("score").alias(f"{name}_score"),
        F.row_number().over(by.orderBy(F.desc("score"), "doc_id")).alias(f"{name}_rank"),
        ((F.col("score") - F.min("score").over(by)) / F.when(span > 0, span).otherwise(1.0)).alias(f"{name}_norm"),
    )


def joined(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    return ranked(dense, "dense").join(ranked(sparse, "sparse"), ["query_id", "doc_id"], "full_outer")


def fuse(dense: DataFrame, sparse: DataFrame, method: str = "linear", alpha: float = 0.9, k: int = 60, top: int | None = None) -> DataFrame:
    """query_id, doc_id, fused, rank.

    Equal scores keep the dense order, then the sparse order of what only the sparse list has.
    """
    if method not in METHODS:
        raise ValueError(f"{method} is none of {', '.join(METHODS)}")
    d, s = F.coalesce("dense_norm", F.lit(0.0)), F.coalesce("sparse_norm", F.lit(0.0))
    both = F.col("dense_rank").isNotNull().cast("int") + F.col("sparse_rank").isNotNull().cast("int")
    score = {
        "rrf": rrf(F.col("dense_rank"), k) + rrf(F.col("sparse_rank"), k),
        "linear": alpha * d + (1 - alpha) * s,
        "combsum": 0.5 * d + 0.5 * s,
        "combmnz": (0.5 * d + 0.5 * s) * both,
        "max": F.greatest(d, s),
    }[method]
    rows = joined(dense, sparse).withColumn("fused", F.round(score, 6))
    order = Window.partitionBy("query_id").orderBy(F.desc("fused"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank"), "doc_id")
    rows = rows.withColumn("rank", F.row_number().over(order))
    return (rows if top is None else rows.filter(F.col("rank") <= top)).select("query_id", "doc_id", "fused", "rank")


def overlap(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """query_id, both, dense_only, sparse_only, overlap (share of the union in both)."""
    a = dense.select("query_id", "doc_id", F.lit(1).alias("a"))
    b = sparse.select("query_id", "doc_id", F.lit(1).alias("b"))
    rows = a.join(b, ["query_id", "doc_id"], "full_outer").groupBy("query_id").agg(
        F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"), F.count_if(F.col("b").isNull()).alias("dense_only"), F.count_if(F.col("a").isNull()).alias("sparse_only")
    )
    return rows.withColumn("overlap", F.round(F.col("both") / (F.col("both") + F.col("dense_only") + F.col("sparse_only")), 6))


def pool_aliases(hits: DataFrame, owners: DataFrame) -> DataFrame:
    """Best score per query and owner of hits on aliases; an id without an owner is its own."""
    named = hits.join(owners.withColumnRenamed("alias_id", "doc_id"), "doc_id", "left")
    return named.groupBy("query_id", F.coalesce("owner_id", "doc_id").alias("doc_id")).agg(F.max("score").alias("score"))
