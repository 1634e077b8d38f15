"""Spark-native analytics for ordered financial series."""
