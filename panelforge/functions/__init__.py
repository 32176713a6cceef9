"""Column expressions: dates, holidays, error metrics."""
