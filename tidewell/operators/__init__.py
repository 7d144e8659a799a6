"""Operators on DataFrames: security, nesting, dataflow, mutation, constraints."""
