"""Tessera: Spark-native analytics for text, activation vectors and explanations."""
