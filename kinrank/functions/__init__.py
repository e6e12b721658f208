"""Column expressions, distributed ranking helpers and metrics."""
