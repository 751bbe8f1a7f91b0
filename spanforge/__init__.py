"""Trace analytics and data preparation on Spark: DataFrames in, DataFrames out."""
