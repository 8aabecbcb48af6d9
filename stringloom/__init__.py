"""Suffix-order text analytics on Spark DataFrames."""
