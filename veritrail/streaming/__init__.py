"""Structured Streaming over the append-only logs."""
