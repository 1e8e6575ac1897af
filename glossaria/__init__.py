"""Spark-native metadata matching and governance analytics."""

__version__ = "0.1.0"
