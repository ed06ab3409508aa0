"""Sequence and k-mer analytics on Spark DataFrames."""
