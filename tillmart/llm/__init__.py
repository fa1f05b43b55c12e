"""Operators for text corpora, each a Spark job over whole tables."""
