"""Spark-native cataloguing, deduplication and planning over large file collections."""
