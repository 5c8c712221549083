"""Graph alignment and graph analytics on Spark DataFrames."""
