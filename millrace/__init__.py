"""Retail catalog, purchase and preference analytics on Spark DataFrames."""
