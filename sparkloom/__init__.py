"""Spark-native metrics engine: describe tables once, ask for metrics by name, get a DataFrame."""
