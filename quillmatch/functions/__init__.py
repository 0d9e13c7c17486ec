"""Column functions: text, JSON, similarity, stemming."""
