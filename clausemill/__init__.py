"""Clause retrieval and evaluation on Spark DataFrames."""
