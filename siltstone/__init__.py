"""Corpus audit engine on Spark DataFrames."""
