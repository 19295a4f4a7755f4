"""Operators over contours, graphs, scores and partitions, each a function from DataFrames to a DataFrame."""
