"""Structured Streaming forms of the two event-log operators."""
