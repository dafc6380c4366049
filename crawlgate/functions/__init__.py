"""Column functions: byte-exact text, URLs, SQL registration."""
