"""helixframe: biological-sequence analytics on Spark DataFrames."""
