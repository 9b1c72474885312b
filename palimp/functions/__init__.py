"""Column functions: patterns with spans, similarity of strings."""
