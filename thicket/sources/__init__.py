"""Readers, writers and path handling."""
