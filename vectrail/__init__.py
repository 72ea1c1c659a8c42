"""Semantic retrieval analytics on Spark DataFrames."""
