"""Column expressions of the dialect."""
