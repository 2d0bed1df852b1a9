"""Deal-price analytics on Spark DataFrames."""
