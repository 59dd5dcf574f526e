"""Structured Streaming forms of the row-level operators."""
