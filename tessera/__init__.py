"""Spark-native analytics for very large two-dimensional point-count tables."""

__version__ = "0.1.0"
