"""Structural text and signature analytics on Spark DataFrames."""
