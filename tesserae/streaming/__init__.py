"""Structured Streaming ingest and expiring state."""
