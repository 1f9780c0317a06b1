"""Column expressions and Arrow UDFs used by the operators."""
