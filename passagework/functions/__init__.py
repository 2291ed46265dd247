"""Column expressions: text, markup cleaning, answer metrics."""
