"""Column expressions (all built-in Catalyst functions, no Python per row)."""
