"""Spark-native curation analytics over time-ordered collections of records."""
