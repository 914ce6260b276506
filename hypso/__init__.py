"""Terrain contour analytics on Spark DataFrames."""
