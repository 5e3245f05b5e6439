"""Spark-native structural duplicate analytics."""
