"""Column expressions with explicit missing-value rules."""
