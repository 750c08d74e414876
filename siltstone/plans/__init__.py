"""Pipelines of operators, and the catalogue of queries over the test tables."""
