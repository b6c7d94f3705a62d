"""Layered document analytics on Spark DataFrames."""
