"""Operators: every function takes and returns DataFrames."""
