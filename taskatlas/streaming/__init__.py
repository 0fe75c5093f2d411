"""Incremental runs on Structured Streaming."""
