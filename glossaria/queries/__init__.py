"""The engine's queries over the driver's tables."""

from glossaria.queries import benchmarking, coercion, evaluating, files, governing, indexing, ingesting, matching, parsing, reviewing, text  # noqa: F401
from glossaria.queries.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
