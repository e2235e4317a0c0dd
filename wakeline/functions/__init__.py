"""Column expressions: no UDFs, everything stays inside the JVM."""
