"""Spark-native corpus and subword-vocabulary analytics."""
