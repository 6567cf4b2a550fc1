"""Corpus operators for training-data pipelines: search, language ID, deduplication, toxicity, sharding,
packing, token storage and BPE. Nothing else in the library imports this package."""
