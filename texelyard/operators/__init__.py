"""Operators on tables: every function takes and returns DataFrames."""
