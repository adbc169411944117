"""Structured Streaming variants for records that keep arriving."""
