"""Operators for large training-text corpora.

Nothing outside this folder imports it; the queries over the test tables are
in :mod:`siltstone.llm.queries`.
"""
