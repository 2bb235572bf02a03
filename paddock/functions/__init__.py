"""Column-level helpers that stay inside whole-stage code generation."""
