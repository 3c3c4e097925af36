"""Fluvial: document analytics on Spark DataFrames."""
