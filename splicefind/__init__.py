"""Embedding time-series matching and interval reconciliation on Spark DataFrames."""
