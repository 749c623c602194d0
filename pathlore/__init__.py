"""pathlore: Spark jobs for very large file-name catalogs and their search."""
