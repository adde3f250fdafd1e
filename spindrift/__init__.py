"""Spatial keyword analytics on Spark DataFrames."""
