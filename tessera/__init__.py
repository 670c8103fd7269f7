"""Tessera: a Spark-native analytics engine for classical machine learning and the relational work beneath it."""

__version__ = "0.1.0"
