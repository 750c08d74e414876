"""Siltstone: content-addressed, versioned data analytics on Spark."""
