"""Column expressions for parts of a log record."""
