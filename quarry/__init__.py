"""Spark-native analytics over source-code and document corpora."""
