"""Reusable relational and temporal operators on DataFrames."""
