"""Queries as text, algebra, search plans, and DataFrames."""
