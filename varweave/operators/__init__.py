"""Relational and domain operators on DataFrames."""
