"""Column expressions of the map model; all stay within generated code."""
