"""Structured Streaming forms of the lookups; an addition, the studied program has none."""
