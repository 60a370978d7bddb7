"""Column expressions and small aggregate helpers, all built from Spark SQL functions."""
