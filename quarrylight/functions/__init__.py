"""Column functions: text, identifiers and rates."""
