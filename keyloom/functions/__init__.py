"""Column expressions over records and keys."""
