"""Spark-native analytics for satellite pixel data over water bodies."""
