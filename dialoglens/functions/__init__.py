"""Column expressions from built-in functions."""
