"""Spark-native analytics over sensitive spans in large document collections."""
