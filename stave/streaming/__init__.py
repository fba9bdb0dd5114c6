"""Structured Streaming forms of the stateful rules."""
