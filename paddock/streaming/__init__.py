"""Incremental modes of two batch operators."""
