"""Readers, writers and column adapters."""
