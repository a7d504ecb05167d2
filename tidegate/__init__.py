"""Keyed-exchange analytics on Spark DataFrames."""
