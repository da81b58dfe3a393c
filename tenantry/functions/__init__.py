"""Column expressions: derived columns and input validation."""
