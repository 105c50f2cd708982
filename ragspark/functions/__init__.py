"""Column functions: text, scalar and vector expressions evaluated inside the JVM."""
