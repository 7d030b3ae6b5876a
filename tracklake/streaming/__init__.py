"""Structured Streaming forms of the ingest and change operators."""
