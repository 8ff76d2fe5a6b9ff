"""Scalar functions on text, markup, identifiers and statistics."""
