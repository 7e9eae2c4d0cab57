"""Spark-native analytics over long-form transcripts."""

__version__ = "0.1.0"
