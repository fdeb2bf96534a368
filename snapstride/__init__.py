"""Spark-native as-of pricing, feature and simulation engine."""
