"""Spark-native catalogue, evidence and content-audit transformations."""
