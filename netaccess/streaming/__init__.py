"""Structured Streaming variants of the aggregations (an extension; the batch operators come first)."""
