"""Spark-native analytics over document knowledge graphs."""
