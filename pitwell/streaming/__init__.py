"""Structured Streaming forms of row checks and as-of state."""
