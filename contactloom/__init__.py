"""Contact-map analytics on Spark: every operator takes DataFrames and gives DataFrames."""
