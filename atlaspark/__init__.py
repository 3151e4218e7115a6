"""Geospatial text search and analytics on Spark DataFrames."""
