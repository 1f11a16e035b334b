"""Spark-native evidence-graph analytics."""
