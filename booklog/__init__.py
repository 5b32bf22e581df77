"""Spark-native analytics for airline booking logs."""
