"""Column-level building blocks; every function returns a JVM-side expression."""
