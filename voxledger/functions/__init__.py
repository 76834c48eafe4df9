"""Column expressions: text cleanup, label parsing, rounding, display."""
