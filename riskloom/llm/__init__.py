"""Operators for preparing text corpora: deduplication, cleaning, scoring, encoding, sharding."""
