"""Structured Streaming forms of the polled-state operators."""
