"""Operators of a training-data pipeline: packing, deduplication, search, archives, rules, scoring, formatting."""
