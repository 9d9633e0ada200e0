"""Compositions of operators and the registry of queries."""
