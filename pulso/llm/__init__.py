"""Operators and queries for building training corpora."""
