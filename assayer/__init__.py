"""Spark-native analytics over grouped, scored and time-indexed tables."""
