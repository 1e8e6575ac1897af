"""Vector arithmetic over arrays of doubles, and rank-fusion scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-9


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.greatest(F.sqrt(dot(v, v)), F.lit(FLOOR))


def normalised(v: Column) -> Column:
    n = norm(v)
    return F.transform(v, lambda x: x.cast("double") / n)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, x: s + x * x))


def squash(score: Column) -> Column:
    """Scores within [0, 1] as they are, others by the logistic function (input held to +-30)."""
    return F.when(score.between(0, 1), score).otherwise(1 / (1 + F.exp(-F.greatest(F.least(score, F.lit(30.0)), F.lit(-30.0)))))


def rrf(rank: Column, k: int = 60) -> Column:
    return F.coalesce(1 / (F.lit(k) + rank), F.lit(0.0))
