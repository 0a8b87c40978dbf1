"""Spark-native retrieval analytics: corpora, queries, rankings and graphs as DataFrames."""

__version__ = "0.1.0"
