"""Exact sequence search and corpus preparation on Spark DataFrames."""
