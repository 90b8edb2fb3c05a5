"""Spark-native analytics for document corpora and the graphs extracted from them."""
