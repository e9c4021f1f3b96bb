"""Tidemark: point-in-time evidence analytics on Spark DataFrames."""
