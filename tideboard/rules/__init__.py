"""Word lists, lookup tables and patterns, kept as plain data."""
