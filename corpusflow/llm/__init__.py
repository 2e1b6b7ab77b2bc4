"""Operators of a training-data pipeline: scoring, duplicates, leaks, secrets, tokens and packing."""
