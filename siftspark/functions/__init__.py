"""Column expressions and the few Python functions that Spark has no expression for."""
