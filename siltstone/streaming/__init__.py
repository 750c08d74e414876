"""Structured Streaming forms of the log operators; each has a batch twin that it is tested against."""
