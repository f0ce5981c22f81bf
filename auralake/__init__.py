"""Spark-native analytics for signal corpora and model-evaluation tables."""
