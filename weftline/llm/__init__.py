"""Operators of a training-data pipeline: near-duplicates, tokens, scoring, archives and text extraction."""
