"""Colour, vector, tile and byte-sequence analytics on Spark DataFrames."""
