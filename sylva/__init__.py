"""sylva: semantic trees, vector search and text analytics on Spark DataFrames."""

__version__ = "0.1.0"
