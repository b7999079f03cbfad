"""Source-text extractors, one module per language."""
