"""Spark-native engine for typed concept graphs over document corpora."""

__version__ = "0.1.0"
