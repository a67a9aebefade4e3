"""Circular-sequence analytics on Spark DataFrames."""
