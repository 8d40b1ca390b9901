"""Spark-native analytics over probabilistic 3-D maps."""
