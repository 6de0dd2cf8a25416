"""Training-data operators: extraction, formatting, mixing, dedup, quality, packing and scoring.

Nothing outside this subpackage imports it, so it can be removed whole.
"""
