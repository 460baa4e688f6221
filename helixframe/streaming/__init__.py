"""Structured Streaming forms of the roll-ups; an extension."""
