"""Spark-native vector search and quantization."""
