"""Operators for training-data pipelines: filters, deduplication, mixing, tokenising and search."""
