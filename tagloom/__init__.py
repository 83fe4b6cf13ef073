"""Tag-graph and vector analytics on Spark DataFrames."""
