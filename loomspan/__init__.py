"""Loomspan: a PySpark-native engine for knowledge bases and their retrieval."""
