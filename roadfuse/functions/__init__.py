"""Pure column functions: no UDFs, everything stays in generated JVM code."""
