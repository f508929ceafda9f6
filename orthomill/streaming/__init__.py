"""Structured Streaming jobs over run diagnostics and reviewer feedback."""
