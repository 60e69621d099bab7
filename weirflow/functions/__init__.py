"""Column expressions: keys, addresses, flags, strings."""
