"""Vectrail: exact vector search, chunking and embedding on Spark DataFrames."""

__version__ = "0.1.0"
