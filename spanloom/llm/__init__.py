"""Operators that prepare training text: deduplication, tokens, media, packing, filters."""
