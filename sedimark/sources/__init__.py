"""Readers, writers and container extraction."""
