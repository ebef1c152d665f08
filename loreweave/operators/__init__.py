"""Operators: DataFrames and a configuration in, a DataFrame out."""
