"""Spark-native analytics for text corpora and the evidence drawn from them."""
