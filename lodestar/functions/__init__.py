"""Column helpers with the semantics the index relies on."""
