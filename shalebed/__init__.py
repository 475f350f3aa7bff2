"""Spark-native analytics over versioned, block-structured and interval-structured data."""
