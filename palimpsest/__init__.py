"""Spark-native engine for entity-centred long-term memory data."""
