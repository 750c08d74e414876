"""Readers: the model's tables, record segments, commit slots, versioned tables."""
