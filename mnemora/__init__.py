"""Spark-native analytics over a recoverable personal-memory store."""
