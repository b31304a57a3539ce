"""Spark-native catalog de-duplication engine."""
