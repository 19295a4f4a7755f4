"""Outline-graph analytics on Spark DataFrames."""
