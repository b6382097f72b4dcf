"""Jobs composed of several operators: indexing and search."""
