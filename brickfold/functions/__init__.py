"""Column builders: pure expressions, no UDF except entity decoding."""
