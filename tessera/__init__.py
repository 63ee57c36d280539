"""Vector, sequence and text analytics on Spark DataFrames."""
