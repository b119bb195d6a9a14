"""Terrain and drainage-network analytics on Spark DataFrames."""
