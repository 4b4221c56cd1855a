"""Column expressions and the few vectorized helpers that Spark lacks."""
