"""Structured Streaming forms of batch plans."""
