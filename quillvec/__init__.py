"""Similarity search, retrieval evaluation and corpus processing on Spark."""
