"""Column functions: everything here stays in generated JVM code."""
