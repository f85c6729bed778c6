"""Spark-native analytics over versioned knowledge-graph data."""
