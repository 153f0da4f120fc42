"""Time-aligned multi-stream recording data as Spark DataFrames."""
