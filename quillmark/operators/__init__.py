"""Relational and document operators."""
