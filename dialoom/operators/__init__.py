"""Operators, each a function of DataFrames."""
