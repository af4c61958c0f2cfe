"""Structured Streaming forms of the parse, the dedup and the rollups."""
