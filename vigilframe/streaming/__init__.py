"""Structured Streaming pipelines over certificate messages and events."""
