"""Operators for large text corpora, one module each; ``queries`` binds them to the given tables."""
