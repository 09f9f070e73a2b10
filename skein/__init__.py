"""Spark-native retrieval engine."""
