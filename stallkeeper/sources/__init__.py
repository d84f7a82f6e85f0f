"""Readers that turn pages and payloads into listing tables."""
