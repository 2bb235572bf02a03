"""Readers and writers for landed tables."""
