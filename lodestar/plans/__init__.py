"""Whole-index plans: virtual test index, indexing, summaries."""
