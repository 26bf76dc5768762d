"""Elevation-change analytics on Spark DataFrames."""
