"""Re-ranking of candidates by a scorer over text pairs or token vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossaria.functions.vectors import squash


def pair_scorer(function: Callable[[list[tuple[str, str]]], list[float]]) -> Callable[[Column, Column], Column]:
    """A column function (query text, document text) -> score from a batch scorer."""

    @F.pandas_udf("double")
    def score(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, d in pairs:
            yield pd.Series([float(x) for x in function(list(zip(q.fillna(""), d.fillna(""))))], dtype=float)

    return score


def token_maxsim(query: Column, document: Column) -> Column:
    """Mean over the query's token vectors of the best dot product with the document's (arrays of arrays)."""

    @F.pandas_udf("double")
    def run(q: pd.Series, d: pd.Series) -> pd.Series:
        def one(a, b):
            if a is None or b is None or not len(a) or not len(b):
                return 0.0
            return float((np.stack([np.asarray(x, float) for x in a]) @ np.stack([np.asarray(x, float) for x in b]).T).max(axis=1).mean())

        return pd.Series([one(a, b) for a, b in zip(q, d)])

    return run(query, document)


def rerank(candidates: DataFrame, score: Column, depth: int = 20) -> DataFrame:
    """``candidates`` (query_id, doc_id, rank, ...) of which the first ``depth`` are ordered anew by the squashed score; the rest keep their places behind them."""
    top = F.col("rank") <= depth
    scored = candidates.withColumn("rerank_score", F.when(top, F.round(squash(score), 6))).withColumnRenamed("rank", "original_rank")
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank_score"), "original_rank")
    return scored.withColumn("rank", F.row_number().over(order))
