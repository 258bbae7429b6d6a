"""Operators of a training-data pipeline: scoring, filtering, deduplication, tokenising, packing."""
