"""Structured Streaming forms of the append-only edit log."""
