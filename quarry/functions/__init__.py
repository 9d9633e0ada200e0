"""Column functions for text, scores and vectors."""
