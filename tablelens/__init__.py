"""Inspect and profile tables and texts with Spark DataFrames."""
