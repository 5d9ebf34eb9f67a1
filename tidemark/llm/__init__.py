"""Operators for training-data pipelines: scoring, search, deduplication, mixing, sharding, tokenizing."""
