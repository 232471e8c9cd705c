"""Spark-native phonetics engine for mixed Chinese-English text."""

__version__ = "0.1.0"
