"""Spark-native analytics for ordered streams of point-like sensor records."""

__version__ = "0.1.0"
