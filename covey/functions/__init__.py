"""Column functions on arrays of doubles, JVM-side."""
