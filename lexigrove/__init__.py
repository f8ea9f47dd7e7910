"""Spark-native engine for building, auditing and scoring cluster taxonomies of text corpora."""
