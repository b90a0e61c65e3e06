"""Spark-native analytics over collections of embedding vectors sampled in time."""
