"""Metadata-driven analytics engine on Spark DataFrames."""
