"""Queries over the given tables: file tables derived from them, and one query for each operator."""
