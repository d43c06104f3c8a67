"""Spark-native document-mapping, retrieval and data-quality operators."""

__version__ = "0.1.0"
