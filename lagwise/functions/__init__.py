"""Column expressions and SQL helpers that the operators share."""
