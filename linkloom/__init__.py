"""Bookmark ingest, enrichment and hybrid search written as Spark DataFrame functions."""

__version__ = "0.1.0"
