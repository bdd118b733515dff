"""Column expressions of the layout algebra."""
