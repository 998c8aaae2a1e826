"""Structured Streaming forms of the sequence operators (an extension)."""
