"""Slide analytics on Spark DataFrames: tiled images, annotations, specimens and metadata."""
