"""Structured Streaming extension of the index build."""
