"""Column-level functions: identifiers, numbers, text, time and vectors."""
