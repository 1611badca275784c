"""Column functions: text, checks, vectors."""
