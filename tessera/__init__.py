"""Tessera: raster frames, shape relations and labelled samples as Spark DataFrames."""
