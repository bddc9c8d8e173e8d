"""Catalogue, text, spatial and stream analytics on Spark DataFrames."""
