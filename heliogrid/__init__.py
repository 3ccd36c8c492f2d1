"""Spark-native time-series and energy analytics."""
