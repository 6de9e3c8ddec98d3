"""Column functions: labels, text and checks."""
