"""Operators for training-data pipelines: filters, near-duplicates, mixing, tokens. Nothing outside imports this."""
