"""Spark-native analytics engine for document-derived tables."""

__version__ = "0.1.0"
