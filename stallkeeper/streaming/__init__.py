"""Structured Streaming variants of the ingest path."""
