"""Operators for training-data pipelines: near duplicates, quality, mixing, chat text, search, secrets, tokens, scoring."""
