"""Spark-native analytics for sampled signals."""

__version__ = "0.1.0"
