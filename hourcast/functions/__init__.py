"""Column expressions: calendar parts, keys, text and dates."""
