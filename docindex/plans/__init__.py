"""Queries: the operators applied to the given tables, and their SQL twins."""
