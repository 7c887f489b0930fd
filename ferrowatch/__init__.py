"""Equipment-condition and maintenance analytics on Spark DataFrames."""
