"""Plumbmark: auditable drawing analytics on Spark DataFrames."""
