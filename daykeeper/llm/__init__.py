"""Operators for preparing training text: dedup, personal data, filters, tokens, packing."""
