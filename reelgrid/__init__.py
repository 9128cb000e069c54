"""Spark-native analytics for catalog search, recommendation and evaluation."""
