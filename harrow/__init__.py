"""Spark-native curation and scoring of text corpora."""
