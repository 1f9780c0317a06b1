"""Structured Streaming forms of the append-only and incremental jobs."""
