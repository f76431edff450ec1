"""Temporal knowledge-graph analytics on Spark DataFrames."""
