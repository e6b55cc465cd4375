"""Foliomill: Spark-native analytics for long, ordered text corpora."""
