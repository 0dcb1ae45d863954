"""Operators for preparing training text: scoring, cleaning, tokens, packing and duplicates."""
