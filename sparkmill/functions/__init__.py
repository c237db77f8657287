"""Column functions: sequences, names and vectors."""
