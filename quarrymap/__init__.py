"""Deterministic repository, graph and retrieval analytics on Spark DataFrames."""
