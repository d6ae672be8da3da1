"""Tiled-image analytics on Spark DataFrames."""
