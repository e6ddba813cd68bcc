"""Catalog, search, assessment and operations analytics on Spark DataFrames."""
