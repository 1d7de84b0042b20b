"""Typed document queries, writes and feeds, and data-pipeline operators, on Spark DataFrames."""
