"""Spark-native analytics for civic and budget data."""
