"""Vellumark: a Spark-native engine for documentation corpora."""
