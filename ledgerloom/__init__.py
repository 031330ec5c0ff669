"""Spark-native analytics over order-book and tick event data."""
