"""Spark-native retrieval and analytics over a corpus of timestamped items."""

__version__ = "0.1.0"
