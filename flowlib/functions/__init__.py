"""Column builders: no data movement, everything stays inside Spark's generated code."""
