"""Scans and sinks: test tables, delimited files, result files, resumable appends."""
from synthlab.sources.tables import load, TABLES  # noqa: F401
