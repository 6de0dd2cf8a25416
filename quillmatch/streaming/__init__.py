"""Structured Streaming (an extension: the batch operators applied to unbounded inputs)."""
