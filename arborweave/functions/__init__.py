"""Scalar functions on sequences, as Column expressions."""
