"""Where files, tables and settings come from."""
