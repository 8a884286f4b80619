"""Relational operators, each ``DataFrame -> DataFrame``."""
