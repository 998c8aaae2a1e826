"""Scalar functions as Column expressions; Python only where Spark has no equal."""
