"""Operators: every function takes DataFrames and returns DataFrames; nothing is collected unless a bound is stated."""
