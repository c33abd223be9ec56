"""Spark-native analytics for the life of a tabular classifier."""
