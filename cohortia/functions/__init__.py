"""Column expressions: text, numbers, arrays, portable hashes."""
