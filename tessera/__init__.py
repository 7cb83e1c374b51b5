"""Spark-native table analytics: positioned text boxes, cells and separators to clean logical tables."""

__version__ = "0.1.0"
