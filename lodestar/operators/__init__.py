"""Relational operators over the index tables."""
