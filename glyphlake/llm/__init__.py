"""Operators of a training-data pipeline: text quality, duplicates, secrets, personal data, tokens and packing."""
