"""Column expressions (JVM-side, codegen'd). No Python UDFs here."""
