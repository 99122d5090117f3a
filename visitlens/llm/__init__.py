"""Operators for large training-text corpora, each a Spark job over whole tables."""
