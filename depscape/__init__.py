"""Spark-native analytics over code dependency graphs."""
