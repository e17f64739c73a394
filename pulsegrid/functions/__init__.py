"""Column expressions: they never touch rows in Python."""
