"""Retrieval, corpus building and evaluation on Spark DataFrames."""
