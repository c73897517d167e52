"""Column expressions: each takes and gives columns."""
