"""Relational and nested operators as DataFrame transforms."""
