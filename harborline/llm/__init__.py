"""Operators of a training-data pipeline: deduplication, sharding, search, secrets, packing, quality, tokens, fingerprints."""
