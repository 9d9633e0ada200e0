"""Search-quality and training-data analytics on Spark DataFrames."""
