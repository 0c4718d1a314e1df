"""Column expressions: text, money and order statistics."""
