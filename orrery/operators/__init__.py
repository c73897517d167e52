"""Operators: each takes and gives DataFrames."""
