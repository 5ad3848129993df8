"""Operators of a training-data pipeline: search, extraction, archives, secrets, dedup, mixing, packing, toxicity."""
