"""Readers, writers and the adapter for the bundled test tables."""
