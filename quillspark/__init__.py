"""Spark-first analytics for word-processor documents and the tables derived from them."""

__version__ = "0.1.0"
