"""Column expressions: text, numbers and geography."""
