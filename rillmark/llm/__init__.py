"""Operators of a training-data pipeline: packing, scoring, sharding, deduplication,
search, classification, counting, mixing and fingerprints."""
