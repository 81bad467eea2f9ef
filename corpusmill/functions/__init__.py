"""Column-level functions (JVM side)."""
