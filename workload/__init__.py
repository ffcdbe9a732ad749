"""Queries over the given tables and, per query, an independent DuckDB statement."""
