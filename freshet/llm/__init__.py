"""Operators for training-data pipelines: search, dedup, extraction, filtering, mixing."""
