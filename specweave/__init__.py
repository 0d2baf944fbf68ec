"""Specweave: contract-metadata analytics and corpus preparation on Spark DataFrames."""
