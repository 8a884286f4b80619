"""Operators of a training-data pipeline over text and embeddings: thirteen DataFrame operators and
their queries.

Nothing else in the library imports this subpackage.
"""
