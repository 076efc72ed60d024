"""Spark-native corpus, token-stream, matrix-table and run-analytics operators."""

__version__ = "0.1.0"
