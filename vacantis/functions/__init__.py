"""Column-in, column-out functions (all JVM side)."""
