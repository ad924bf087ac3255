"""Operators: DataFrames in, a DataFrame out, no action inside unless a docstring says so."""
