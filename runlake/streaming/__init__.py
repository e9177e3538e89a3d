"""Structured Streaming versions of the run and incident operators."""
