"""Operators for building training corpora: filters, deduplication, scoring, sharding, archives and tokens."""
