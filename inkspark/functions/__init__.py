"""Column expressions: DataFrame-free building blocks that stay inside the JVM."""
