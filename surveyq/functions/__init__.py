"""Column builders: text, vector and score functions."""
