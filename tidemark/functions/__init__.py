"""Column expressions that Spark has no builtin for."""
