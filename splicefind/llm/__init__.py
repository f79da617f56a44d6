"""Operators of a training-data pipeline over ``documents``-like tables.

Nothing outside this subpackage imports it.  Every operator is a function from
DataFrames to a DataFrame; module ``queries`` holds the registered queries.
"""
