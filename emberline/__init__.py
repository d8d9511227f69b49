"""Wildfire and mobility analytics on Spark DataFrames."""
