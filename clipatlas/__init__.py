"""Scene catalogues and vector search as plain Spark jobs."""
