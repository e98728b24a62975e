"""Spark-native document analytics: sources, operators, functions, plans and streaming."""
