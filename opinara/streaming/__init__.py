"""Structured Streaming form of file classification."""
