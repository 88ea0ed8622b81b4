"""Spark-native analytics for multi-condition, multichannel biosignal studies."""

__version__ = "0.1.0"
