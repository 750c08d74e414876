"""Queries over the test tables, by subject."""
