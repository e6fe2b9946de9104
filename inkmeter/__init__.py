"""Corpus marker analytics on Spark DataFrames."""
