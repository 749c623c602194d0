"""Column functions of names, paths, queries and scores."""
