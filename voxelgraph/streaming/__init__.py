"""Structured Streaming entry: subjects that arrive as files."""
