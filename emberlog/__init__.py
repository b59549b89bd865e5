"""Ordered, multi-version key-value analytics expressed as Spark DataFrames."""
