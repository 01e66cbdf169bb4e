"""Spanloom: a Spark-native engine for typed symbol graphs and large text corpora."""
