"""Column builders: text, vectors and row-local voting."""
