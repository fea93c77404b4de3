"""Spark-native forecast verification and tabular/corpus data processing."""
