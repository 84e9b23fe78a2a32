"""Operators for preparing training text: each takes and returns DataFrames and works on whole texts."""
