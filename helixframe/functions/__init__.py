"""Column expressions: geometry, text, arrays, colours."""
