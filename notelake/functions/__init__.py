"""Column functions: DataFrame columns in, columns out."""
