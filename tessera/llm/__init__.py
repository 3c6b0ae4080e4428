"""Operators for preparing language-model training data (quality, mixing, search, dedup, packing, scoring)."""
